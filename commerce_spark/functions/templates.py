"""SQL templates: names are checked identifiers, values are named arguments; neither is ever pasted as it comes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scalar import identifier

PLACE = re.compile(r"__([A-Z][A-Z0-9]*)__")


def filled(template: str, names: dict[str, str]) -> str:
    """The template with each __NAME__ replaced by its identifier (or identifiers with dots between). A place without a
    name, a name without a place and whatever isn't an identifier are errors."""
    places = set(PLACE.findall(template))
    if places != set(names):
        raise ValueError(f"names and places differ: {sorted(places ^ set(names))}")
    safe = {k: ".".join(f"`{identifier(p)}`" for p in v.split(".")) for k, v in names.items()}
    return PLACE.sub(lambda m: safe[m[1]], template)


def query(spark: SparkSession, template: str, names: dict[str, str] | None = None, **values) -> DataFrame:
    """The template's rows: `names` for tables and columns (IDENTIFIER(:x) takes them from `values`, too), `values` for
    the :markers, which Spark binds as literals of their Python types."""
    asked = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", re.sub(r"'(?:[^'\\]|\\.)*'", "''", template)))
    if asked != set(values):
        raise ValueError(f"markers and values differ: {sorted(asked ^ set(values))}")
    return spark.sql(filled(template, names or {}), args=values)
