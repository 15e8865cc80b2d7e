"""Structured log events: one JSON line a stage, with counts that the stage's own job observed."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("commerce_spark")


@contextmanager
def stage_event(run: str, stage: str, entity: str | None = None, log: logging.Logger = LOG) -> Iterator[dict]:
    """A stage of a run: what the block puts into the dict is logged with its seconds, and the error where it fails."""
    event: dict = {"execucao": run, "etapa": stage} | ({"entidade": entity} if entity else {})
    began = time.monotonic()
    try:
        yield event
        event["status"] = "ok"
    except Exception as e:
        event |= {"status": "erro", "erro": str(e)[:2000]}
        raise
    finally:
        event["segundos"] = round(time.monotonic() - began, 3)
        log.log(logging.INFO if event.get("status") == "ok" else logging.ERROR, json.dumps(event, ensure_ascii=False, default=str))


def observed(seen: Observation) -> dict | None:
    """What an observation saw, once its action has succeeded; None if Spark knew that there are no rows and ran nothing."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "AssertionError" in str(e.java_exception):
            return None
        raise


class Watched:
    """A DataFrame whose rows, and other measures, are counted by whatever action runs on it first: no job of their own.

    measures: SQL aggregates by name, beside `registros`, the number of rows.
    """

    def __init__(self, df: DataFrame, **measures: str):
        self._seen = Observation()
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("registros"), *[F.expr(v).alias(k) for k, v in measures.items()])

    def measured(self) -> dict:
        """The measures; call it after an action on `rows` has succeeded, for it waits for one. Without rows `registros` alone."""
        found = observed(self._seen)
        return {"registros": 0} if found is None else found
