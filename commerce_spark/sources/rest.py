"""A REST source with cursor pages as a Python data source: spark.read.format("commerce_rest")."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RETRIED = {429, *range(500, 600)}
LONGEST_WAIT = 60.0


def _open(url: str):
    return urllib.request.urlopen(url, timeout=LONGEST_WAIT)


def _instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def fetch(url: str, attempts: int = 4, sleep=time.sleep, opener=_open) -> dict:
    """One page; 429 and 5xx are tried again with growing waits (Retry-After first), other errors fail at once."""
    for n in range(attempts):
        try:
            with opener(url) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == attempts - 1:
                raise
            told = e.headers.get("Retry-After") if e.headers else None
            sleep(min(LONGEST_WAIT, float(told) if told and told.isdigit() else 2.0**n))
        except (urllib.error.URLError, TimeoutError):
            if n == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT, 2.0**n))
    raise RuntimeError("no attempt was made")


def pages(url: str, low: str, high: str, size: int = 500, time_field: str = "atualizado_em", get=fetch) -> Iterator[dict]:
    """The rows of all pages with low <= time < high. A list that is none, a row outside the window or a cursor that
    comes again is an error. Instants are compared as such, whatever their offsets; one without is UTC."""
    cursor, seen, first, end = None, set(), _instant(low), _instant(high)
    while True:
        query = {"inicio": low, "fim": high, "limite": size} | ({"cursor": cursor} if cursor else {})
        body = get(f"{url}?{urllib.parse.urlencode(query)}")
        rows = body.get("itens")
        if not isinstance(rows, list):
            raise ValueError("the answer has no list of rows")
        for r in rows:
            if not first <= _instant(r[time_field]) < end:
                raise ValueError("a row lies outside the window")
            yield r
        cursor = body.get("proximo_cursor")
        if not cursor:
            return
        if cursor in seen:
            raise ValueError("the cursor doesn't advance")
        seen.add(cursor)


class _Slice(InputPartition):
    def __init__(self, low: str, high: str):
        self.low, self.high = low, high


class RestSource(DataSource):
    """Options: url, fields (a DDL schema), windows (JSON list of [low, high] texts; one task each), size, time_field."""

    @classmethod
    def name(cls) -> str:
        return "commerce_rest"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [_Slice(*w) for w in json.loads(self.options["windows"])]

    def read(self, partition: _Slice | None) -> Iterator[tuple]:
        if partition is None:  # no window, no rows
            return
        o = self.options
        for r in pages(o["url"], partition.low, partition.high, int(o.get("size", 500)), o.get("time_field", "atualizado_em")):
            yield tuple(r.get(n) for n in self.names)


ALLOWED = {"erp": {"vendedores", "clientes", "produtos", "vendas", "devolucoes"}, "api": {"metas"}}


def allow(source: str, entity: str) -> None:
    """Each source serves its own entities only."""
    if entity not in ALLOWED.get(source, set()):
        raise ValueError(f"{source} doesn't serve {entity}")
