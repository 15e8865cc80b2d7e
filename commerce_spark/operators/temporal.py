"""Temporal operators: as-of join, state at close, overlaps, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_of(facts: DataFrame, history: DataFrame, key: str, instant: str, take: list[str]) -> DataFrame:
    """Facts with the history row valid at their instant ([valid_from, valid_to), null: open); left-preserving.

    One equi-join on the key with the interval as a residual, so it shuffles once by key and AQE can split a hot key.
    """
    h = history.select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *take)
    within = (F.col(key) == F.col("_k")) & (F.col(instant) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(instant) < F.col("_to")))
    return facts.join(h, within, "left").drop("_k", "_from", "_to")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """competencia (first of month) and fim_exclusivo (start of the next month)."""
    row = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 month)")).alias("competencia"))
    return row.withColumn("fim_exclusivo", F.add_months("competencia", 1).cast("timestamp"))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Calendar attributes of each day; dia_semana 1 is Sunday."""
    d = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 day)")).alias("data"))
    weekday = F.dayofweek("data")
    return d.select(
        "data", F.year("data").alias("ano"), F.month("data").alias("mes"), F.dayofmonth("data").alias("dia"), F.quarter("data").alias("trimestre"),
        F.date_format("data", "yyyy-MM").alias("ano_mes"), F.date_format("data", "MMMM").alias("nome_mes"), weekday.alias("dia_semana"), (~weekday.isin(1, 7)).alias("dia_util"),
    )


def spans_at_close(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """The history rows that are in force just before the end of some month of the calendar, with inicio and fim: the first
    and the last such month. The calendar gives first and last month only."""
    span = calendar.agg(F.min("competencia").alias("_first"), F.max("competencia").alias("_last"))
    h = history.crossJoin(F.broadcast(span))
    start = F.greatest(F.trunc("valid_from", "MM"), F.col("_first"))
    end = F.least(F.coalesce(F.add_months(F.trunc("valid_to", "MM"), -1), F.col("_last")), F.col("_last"))
    return h.where(start <= end).withColumn("inicio", start).withColumn("fim", end).drop("_first", "_last")


def state_at_close(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """The history row in force just before the end of each month of the calendar.

    Each version is exploded over the months it spans instead of compared with all months: the work is the
    result's size.
    """
    h = spans_at_close(history, calendar)
    return h.withColumn("competencia", F.explode(F.sequence("inicio", "fim", F.expr("interval 1 month")))).drop("inicio", "fim")


def overlaps(history: DataFrame, key: str, version: str) -> DataFrame:
    """All pairs of versions of one key whose intervals meet; the smaller version comes first."""
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))
    a = history.select(key, version, F.col("valid_from").alias("_from"), end.alias("_end"))
    b = history.select(key, F.col(version).alias("other"), F.col("valid_from").alias("_other_from"), end.alias("_other_end"))
    return a.join(b, key).where((F.col(version) < F.col("other")) & (F.col("_from") < F.col("_other_end")) & (F.col("_other_from") < F.col("_end"))).select(key, version, "other")


def half_open(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows with low <= column < high."""
    return df.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


def after_row(df: DataFrame, columns: list[str], values: list) -> DataFrame:
    """Rows after a position in the order of several columns: (a, b) > (x, y)."""
    return df.where(F.struct(*columns) > F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)]))
