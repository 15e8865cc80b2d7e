"""Positions and running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commerce_spark.sources.scratch import kept


def running(df: DataFrame, group: str, value: str, tie: str, block: int | None = None, copies: str | None = None) -> DataFrame:
    """df with _pos (from 1) and _cum (sum of value up to the row) by falling value (nulls last), then rising tie, in each
    group, and the group's _n (rows) and _total (sum of value).

    Rows are dealt out by ranges of (group, value, tie), so no task holds a group, nor all rows of one value: a lane is the
    part of a group in one range, and what earlier lanes hold comes from one row a lane. The dealt rows are written once, as
    their ranges must not change between the two looks at them. block: about how many rows a range holds; by default there
    are as many ranges as shuffle partitions. copies: a column that says how many equal rows a row stands for; _pos is the
    first one's then, _cum is past the last, and _n and _total count all.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if block is None else max(1, -(-df.count() // block))
    falling = F.desc_nulls_last(value)
    rows = kept(df.repartitionByRange(parts, F.col(group), falling, F.col(tie)).withColumn("_lane", F.spark_partition_id()), "ranked")
    many = F.lit(1) if copies is None else F.col(copies)
    worth = F.col(value) if copies is None else F.col(value) * F.col(copies)
    lanes = rows.groupBy(group, "_lane").agg(F.sum(many).alias("_rows"), F.sum(worth).alias("_sum"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    start = lanes.select(group, "_lane", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"), F.sum("_sum").over(before).alias("_v0"), F.sum("_rows").over(whole).alias("_n"), F.sum("_sum").over(whole).alias("_total"))
    inside = Window.partitionBy(group, "_lane").orderBy(falling, tie)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_row", F.sum(many).over(up_to) - many + 1).withColumn("_own", F.sum(worth).over(up_to))
    kind = df.schema[value].dataType
    sums = (F.coalesce("_v0", F.lit(0)) + F.coalesce("_own", F.lit(0))).cast(kind).alias("_cum")
    return own.join(start, [group, "_lane"]).select(*df.columns, (F.col("_n0") + F.col("_row")).alias("_pos"), sums, "_n", F.col("_total").cast(kind).alias("_total"))
