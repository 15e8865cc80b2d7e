"""File sources and sinks: JSON lines, JSON exports, incremental scans. The versioned store is in `store`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commerce_spark.sources.store import Layout, Store, signature

__all__ = ["Layout", "Store", "dimension", "exported", "imported", "inside", "jdbc_window", "jsonl", "signature", "windowed", "with_defaults"]


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def dimension(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A dimension from JSON lines; a row without its key is an error."""
    df = jsonl(spark, path, schema)
    if not df.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is missing in {path}")
    return df


def inside(path: str, folders: Iterable[str]) -> str:
    """path, if it lies in one of the folders: with its scheme, and without ways up, empty names or wildcards."""
    scheme, at = path.split("://", 1) if "://" in path else ("", path)
    names = at.split("/")
    if any(n in (".", "..") for n in names) or "" in names[1:] or set("*?[]{}\\,\0") & set(at):
        raise ValueError(f"not a plain path: {path!r}")
    for f in folders:
        own, root = f.split("://", 1) if "://" in f else ("", f)
        if own == scheme and at.startswith(f"{root.rstrip('/')}/"):
            return path
    raise ValueError(f"{path!r} lies in none of the folders that are allowed")


def exported(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of all tables as (objeto, registro as JSON)."""
    parts = [df.select(F.lit(name).alias("objeto"), F.to_json(F.struct("*")).alias("registro")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def imported(snapshot: DataFrame, name: str, schema: str) -> DataFrame:
    """One table of an export, decimals exact."""
    return snapshot.where(F.col("objeto") == name).select(F.from_json("registro", schema).alias("r")).select("r.*")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that older files lack, or null values, by their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def windowed(df: DataFrame, column: str, low, high, after: Iterable | None = None, key: str | None = None, page: int | None = None) -> DataFrame:
    """An incremental scan: low <= column < high, optionally the next page after (time, key) in their order."""
    out = df.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
    if after is not None:
        t, k = after
        out = out.where(F.struct(column, key) > F.struct(F.lit(t).alias(column), F.lit(k).alias(key)))
    return out.orderBy(column, key).limit(page) if page else out


def jdbc_window(spark: SparkSession, url: str, table: str, column: str, low: str, high: str, partition: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """The same scan of a JDBC table, the window pushed into its query; partitioned by a numeric column if bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    if partition and bounds:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load().where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
