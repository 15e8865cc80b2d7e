"""Data-quality operators: every check is a DataFrame of violations; a gate raises with the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _told(df: DataFrame, entity: str, key: Column, rule: str) -> DataFrame:
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.lit(rule).alias("rule"))


def unique(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _told(found, entity, F.concat_ws("/", *keys), f"unique {', '.join(keys)}")


def not_null(df: DataFrame, entity: str, column: str, key: str) -> DataFrame:
    return _told(df.where(F.col(column).isNull()), entity, F.col(key), f"not null {column}")


def accepted(df: DataFrame, entity: str, column: str, values: list, key: str) -> DataFrame:
    return _told(df.where(~F.col(column).isin(values)), entity, F.col(key), f"accepted {column}")


def related(df: DataFrame, entity: str, column: str, parent: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    known = parent.select(F.col(parent_key).alias(column)).distinct()
    return _told(df.where(F.col(column).isNotNull()).join(known, column, "left_anti"), entity, F.col(key), f"related {column}")


def holds(df: DataFrame, entity: str, condition: Column, rule: str, key: str) -> DataFrame:
    """Rows for which the condition isn't true (null counts as not)."""
    return _told(df.where(~F.coalesce(condition, F.lit(False))), entity, F.col(key), rule)


def all_of(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def gate(violations: DataFrame, shown: int = 20) -> None:
    """Raises with the first violations in order, or returns."""
    found = violations.orderBy("entity", "key", "rule").limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{r.entity}/{r.key}: {r.rule}" for r in found))
