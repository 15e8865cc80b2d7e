"""A table behind any DB-API driver as a Spark source: a half-open window read in keyset pages within one snapshot.

    spark.dataSource.register(KeysetSource)
    spark.read.format("keyset").schema("id bigint, atualizado_em timestamp, nome string").options(
        driver="sqlite3", arguments='["/data/erp.db"]', table="vendas", time="atualizado_em", key="id",
        low="2026-01-01T00:00:00+00:00", high="2026-01-02T00:00:00+00:00", page="500").load()

A reader opens one connection and one transaction, so all its pages see the state of its first one, and each page goes on
after the last (time, key), so rows that come, go or move meanwhile neither show nor shift others. Filters on columns of
the table go into its queries (with spark.sql.python.filterPushdown.enabled), and only columns of the schema are asked for.
By default one task reads the window; `parts` splits it by ranges of an integer key, each with a snapshot of its own: a row
that changes between those snapshots has a time past `high` and belongs to the next window.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from commerce_spark.functions.scalar import identifier

#: What begins a transaction whose reads see one state, by driver; another driver names its own in the option `snapshot`.
SNAPSHOTS = {"sqlite3": "BEGIN", "psycopg": "BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY", "psycopg2": "BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY"}
MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def table_name(name: str) -> str:
    """A table's name with its schema, if both are identifiers."""
    return ".".join(identifier(p) for p in name.split("."))


def bound(value, driver: str):
    """A value as the driver takes it; sqlite3 holds instants as ISO texts in UTC and exact numbers as texts."""
    if isinstance(value, datetime):
        value = (value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value).astimezone(timezone.utc)
        return value.isoformat() if driver == "sqlite3" else value
    if driver == "sqlite3" and isinstance(value, (date, Decimal)):
        return str(value)
    return value


def typed(value, kind: T.DataType):
    """A driver's value as Spark wants it for a type; what doesn't fit is an error."""
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        at = value if isinstance(value, datetime) else datetime.fromisoformat(value)
        if at.tzinfo is None:
            raise ValueError(f"an instant without its offset: {value!r}")
        return at
    if isinstance(kind, T.DateType):
        return value if isinstance(value, date) else date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.BooleanType):
        if value not in (0, 1):
            raise ValueError(f"not a boolean: {value!r}")
        return bool(value)
    if isinstance(kind, T.StringType):
        return value.isoformat() if hasattr(value, "isoformat") else str(value)
    return value


class KeyRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class KeysetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.fields = [(identifier(f.name), f.dataType) for f in schema.fields]
        self.driver, self.arguments = o["driver"], json.loads(o.get("arguments", "[]"))
        self.table, self.time, self.key = table_name(o["table"]), identifier(o["time"]), identifier(o["key"])
        names = {n for n, _ in self.fields}
        if missing := {self.time, self.key} - names:
            raise ValueError(f"the schema lacks {sorted(missing)}, by which pages are told apart")
        self.page = int(o.get("page", 500))
        if self.page < 1:
            raise ValueError("a page has one row at least")
        self.snapshot = o.get("snapshot", SNAPSHOTS.get(self.driver))
        if self.snapshot is None:
            raise ValueError(f"no snapshot is known for {self.driver}; give one")
        self.parts, self.least, self.most = int(o.get("parts", 1)), int(o.get("least", 0)), int(o.get("most", 0))
        self.conditions: list[tuple[str, str, list]] = []  # column, operator, values
        for side, sign in (("low", ">="), ("high", "<")):
            if side in o:
                at = datetime.fromisoformat(o[side])
                if at.tzinfo is None:
                    raise ValueError(f"{side} needs its offset")
                self.conditions.append((self.time, sign, [at]))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = dict(self.fields)
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            exact = column in kinds and not isinstance(kinds[column], (T.FloatType, T.DoubleType, T.StringType, T.BooleanType))
            if type(f) in COMPARED and exact:
                self.conditions.append((column, COMPARED[type(f)], [f.value]))
            elif isinstance(f, In) and exact and len(f.value) <= 100 and None not in f.value:
                self.conditions.append((column, "IN", list(f.value)))
            elif isinstance(f, IsNotNull) and column in kinds:
                self.conditions.append((column, "IS NOT NULL", []))
            elif isinstance(f, IsNull) and column in kinds:
                self.conditions.append((column, "IS NULL", []))
            else:  # texts compare by the database's collation, floats by its rounding: Spark's own rules hold for them
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.parts <= 1:
            return [KeyRange(None, None)]
        cuts = [self.least + (self.most - self.least) * i // self.parts for i in range(1, self.parts)]
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def statement(self, part: KeyRange, after: tuple | None) -> tuple[str, list]:
        """The query of the page after (time, key), and its values."""
        mark = MARKS[importlib.import_module(self.driver).paramstyle]
        where, values = [], []
        held = list(self.conditions)
        if part.low is not None:
            held.append((self.key, ">=", [part.low]))
        if part.high is not None:
            held.append((self.key, "<", [part.high]))
        for column, sign, given in held:
            where.append(f"{column} {sign}" + (f" ({', '.join([mark] * len(given))})" if sign == "IN" else f" {mark}" * len(given)))
            values += given
        if after is not None:
            where.append(f"({self.time} > {mark} OR ({self.time} = {mark} AND {self.key} > {mark}))")
            values += [after[0], after[0], after[1]]
        columns = ", ".join(n for n, _ in self.fields)
        text = f"SELECT {columns} FROM {self.table}" + (f" WHERE {' AND '.join(where)}" if where else "") + f" ORDER BY {self.time}, {self.key} LIMIT {self.page}"
        return text, [bound(v, self.driver) for v in values]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        module = importlib.import_module(self.driver)
        given = self.arguments
        db = module.connect(**given) if isinstance(given, dict) else module.connect(*given)
        if self.driver == "sqlite3":
            db.isolation_level = None  # transactions begin where we say
        elif hasattr(db, "autocommit"):
            db.autocommit = True
        names = [n for n, _ in self.fields]
        t, k = names.index(self.time), names.index(self.key)
        try:
            cursor = db.cursor()
            cursor.execute(self.snapshot)
            after = None
            while True:
                cursor.execute(*self.statement(partition, after))
                rows = cursor.fetchall()
                for r in rows:
                    yield tuple(typed(v, kind) for v, (_, kind) in zip(r, self.fields, strict=True))
                if len(rows) < self.page:
                    return
                after = (rows[-1][t], rows[-1][k])
        finally:
            db.close()


class KeysetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return KeysetReader(schema, dict(self.options))


def keyset(spark: SparkSession, schema: str, driver: str, arguments: list | dict, table: str, time: str, key: str, **options) -> DataFrame:
    """The window of a table; options: low, high, page, snapshot, parts with least and most."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)
    reader = spark.read.format("keyset").schema(schema).option("driver", driver).option("arguments", json.dumps(arguments)).option("table", table).option("time", time).option("key", key)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
