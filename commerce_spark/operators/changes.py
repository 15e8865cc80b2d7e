"""Data-change operators as DataFrame algebra: latest versions, conflicts, merges, histories, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import content_hash


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (give a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys that come with more than one content, by its 64-bit hash: numbers are aggregated without a sort of texts."""
    hashed = df.select(*keys, F.xxhash64(F.to_json(F.struct(*content))).alias("_content"))
    found = hashed.groupBy(*keys).agg(F.min("_content").alias("_a"), F.max("_content").alias("_b"))
    return found.where("_a <> _b").select(*keys)


def deduplicate(df: DataFrame, keys: list[str], version: str, content: list[str]) -> DataFrame:
    """The newest version of each key; one version with two contents is an error."""
    if not conflicts(df, [*keys, version], content).isEmpty():
        raise ValueError(f"one version of {keys} has different contents")
    return latest(df, keys, [F.col(version).desc(), content_hash(*content)])


def insert_only(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows, once each, whose key the target hasn't."""
    return batch.dropDuplicates().join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Source rows win on an equal or higher version; absent keys stay."""
    both = target.withColumn("_s", F.lit(0)).unionByName(source.withColumn("_s", F.lit(1)))
    return latest(both, keys, [F.col(version).desc(), F.col("_s").desc()]).drop("_s")


def full_sync(target: DataFrame, source: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The source's keys: its row on a higher version or a new key, the target's row otherwise."""
    columns = source.columns
    old = target.select(F.struct(*columns).alias("_t"), *keys)
    new = source.select(F.struct(*columns).alias("_s"), *keys)
    joined = new.join(old, keys, "left")
    kept = F.when(F.col(f"_t.{version}").isNotNull() & ~(F.col(f"_s.{version}") > F.col(f"_t.{version}")), F.col("_t")).otherwise(F.col("_s"))
    return joined.select(kept.alias("_r")).select("_r.*")


def scd2(history: DataFrame, snapshot: DataFrame, key: str, updated: str) -> DataFrame:
    """History with valid_from and valid_to after a snapshot, by the timestamp strategy.

    A key whose `updated` is later than that of its open row closes it at that instant and opens a new row; an equal
    one changes nothing even if attributes differ; keys absent from the snapshot stay open.
    """
    attributes = [c for c in history.columns if c not in ("valid_from", "valid_to")]
    opened = history.where("valid_to is null").select(F.col(key), F.col(updated).alias("_old"))
    newer = snapshot.join(opened, key, "left").where(F.col("_old").isNull() | (F.col(updated) > F.col("_old")))
    rows = newer.select(*attributes, F.col(updated).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    closing = newer.where("_old is not null").select(F.col(key), F.col(updated).alias("_close"))
    closed = history.join(closing, key, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_close")).otherwise(F.col("valid_to"))).select(*history.columns)
    return closed.unionByName(rows.select(*history.columns))


def versions_to_history(versions: DataFrame, key: str, updated: str) -> DataFrame:
    """A type-2 history from all versions of each key: [valid_from, valid_to), null for the current one."""
    w = Window.partitionBy(key).orderBy(updated)
    return versions.withColumn("valid_from", F.col(updated)).withColumn("valid_to", F.lead(updated).over(w))


def advance(watermarks: DataFrame, reached: DataFrame, key: str = "entity", value: str = "value") -> DataFrame:
    """The later of old and new watermark of each entity."""
    return watermarks.select(key, value).unionByName(reached.select(key, value)).groupBy(key).agg(F.max(value).alias(value))


def quarantine(evaluated: DataFrame, current: DataFrame, resolved: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows rejected for a field, and current rows whose reference isn't resolved."""
    columns = [c for c in evaluated.columns if c != "reason"]
    waiting = current.join(resolved.select(key), key, "left_anti").select(*columns, F.lit(reason).alias("reason"))
    return evaluated.where("reason is not null").select(*columns, "reason").unionByName(waiting)
