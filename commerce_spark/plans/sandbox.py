"""A second publication: consolidated tables of a successful run, truncated and loaded into another store.

Two phases: all tables are written and checked first, then one manifest shows them all. It needs leave, twice: before
anything is written and again before it shows. Leave fails closed: what doesn't say plainly that it may, may not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commerce_spark.operators.telemetry import stage_event
from commerce_spark.plans.incremental import Runs
from commerce_spark.sources.store import Store


def unbilled(info: dict) -> None:
    """Raises unless the account says that billing is off: missing, null or other answers are no leave."""
    if not isinstance(info, dict) or info.get("billingEnabled") is not False or info.get("billingAccountName"):
        raise ValueError("the target may not have a billing account")


def enforced(df: DataFrame, schema: str, name: str) -> DataFrame:
    """df in exactly the columns and types given, all required: other columns or types are an error now, a null fails the
    job that writes the rows."""
    kind = T.StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in kind.fields}
    if have != want:
        off = sorted(c for c in have.keys() | want.keys() if have.get(c) != want.get(c))
        raise ValueError(f"{name}: columns are not as declared: {', '.join(off)}")
    filled = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{name}: {c} is required")).cast(want[c])).otherwise(F.col(c)).alias(c)
    return df.select(*[filled(c) for c in want])


class Sandbox:
    def __init__(self, spark: SparkSession, folder: str, account: Callable[[], dict]):
        self.spark, self.store, self.account = spark, Store(spark, folder), account

    def publish(self, runs: Runs, run: str) -> dict[str, int]:
        """Replace all tables by those that the run published; rows by table. Only a run that succeeded is taken, and a
        failure before the last step leaves the target as it was."""
        if (found := runs.status(run)) != "sucesso":
            raise ValueError(f"run {run} is {found}, not sucesso")
        unbilled(self.account())
        frames = {n: enforced(runs.published(n), e.schema, n) for n, e in runs.entities.items()}
        counted: dict[str, int] = {}
        with stage_event(run, "sandbox") as event:
            self.store.commit(replaced=frames, layouts={n: e.layout for n, e in runs.entities.items()}, state={"run": run}, counted=counted, before=lambda: unbilled(self.account()))
            event["registros"] = counted
        return counted
