"""A versioned store of tables: laid out by partition, sorted inside, published together.

A version is a manifest: for each table its schema, its layout and, by partition, the folders that hold its rows. A commit
writes new folders and then renames its manifest into place, so readers see all tables of a version or none, and what a
commit doesn't touch stays as files, byte for byte. Everything goes through Hadoop's file systems. The rename is atomic on
HDFS and local disks; on an object store without atomic renames use one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commerce_spark.functions.scalar import identifier
from commerce_spark.operators.telemetry import observed

COMMIT = "_commit"  # the folder level of a commit; a hidden partition column of every table
NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Layout:
    """How a table lies on disk: partition columns (of the table, or name=expression for derived ones that readers don't
    see) and the columns that rows are sorted by inside a file, so that row groups prune too."""

    by: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [identifier(b.split("=", 1)[0]) for b in self.by]

    @property
    def derived(self) -> dict[str, str]:
        return dict(b.split("=", 1) for b in self.by if "=" in b)


def signature(df: DataFrame) -> str:
    """A fingerprint of a table's rows whatever their order: row count and sums of hashes."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(3)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256(str(tuple(row)).encode()).hexdigest()


def _told(value) -> str | None:
    """A partition's value as text, as the manifest has it: Spark writes an empty text as null."""
    if isinstance(value, bool):
        return str(value).lower()
    return None if value is None or value == "" else str(value)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/_versions"))

    # --- versions ------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The commit history: version numbers, oldest first."""
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.folder}/_versions")) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"tables": {}, "state": {}}
        at = self._path(f"{self.folder}/_versions/{found[-1] if version is None else version}")
        stream = self._fs.open(at)  # one small file: no job for it
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, body: dict, version: int) -> int:
        at = self._path(f"{self.folder}/_versions/{version}")
        tmp = self._path(f"{self.folder}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(tmp, at):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    # --- reading -------------------------------------------------------------------------------------------------

    def folders(self, name: str, where: dict[str, Iterable] | None = None, version: int | None = None) -> list[str]:
        """The folders of a table, or of those of its partitions whose columns have one of the values given."""
        table = self.manifest(version)["tables"].get(name)
        return [p for _, p in self._chosen(table, where)] if table else []

    def partitions(self, name: str, version: int | None = None) -> list[dict[str, str | None]]:
        """The partitions' values, as text."""
        table = self.manifest(version)["tables"].get(name)
        return [dict(zip(table["by"], json.loads(k), strict=True)) for k in sorted(table["parts"])] if table else []

    @staticmethod
    def _chosen(table: dict, where: dict[str, Iterable] | None) -> list[tuple[str, str]]:
        wanted = {c: {_told(v) for v in vs} for c, vs in (where or {}).items()}
        if unknown := set(wanted) - set(table["by"]):
            raise ValueError(f"not partition columns: {sorted(unknown)}")
        return [(k, p) for k, paths in sorted(table["parts"].items()) if all(_told(v) in wanted[c] for c, v in zip(table["by"], json.loads(k), strict=True) if c in wanted) for p in paths]

    def read(self, name: str, schema: str | T.StructType | None = None, version: int | None = None, where: dict[str, Iterable] | None = None) -> DataFrame:
        """A table as published; an empty one of the given schema if it was never written.

        where: values of partition columns, derived ones too; only those partitions' folders are listed. A filter on a
        partition column that the table has prunes its files in Spark's own way as well.
        """
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        kind = T.StructType.fromJson(table["schema"])
        if schema is not None:
            asked = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            kind = T.StructType([*asked.fields, *[f for f in kind.fields if f.name in table["hidden"]]])
        show = [f.name for f in kind.fields if f.name not in table["hidden"]]
        paths = [f"{self.folder}/{p}" for _, p in self._chosen(table, where)]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([kind[c] for c in show]))
        reader = self.spark.read.option("basePath", f"{self.folder}/{identifier(name)}").schema(T.StructType([*kind.fields, T.StructField(COMMIT, T.StringType())]))
        return reader.parquet(*paths).select(*show)

    # --- writing -------------------------------------------------------------------------------------------------

    def _write(self, name: str, df: DataFrame, layout: Layout, counted: dict[str, int] | None = None) -> dict:
        """df as new folders; what the manifest says of it."""
        identifier(name)
        if clash := {COMMIT, *layout.derived} & set(df.columns):
            raise ValueError(f"{name} has columns that the layout makes: {sorted(clash)}")
        made = df.withColumns({c: F.expr(e) for c, e in layout.derived.items()}) if layout.derived else df
        seen = Observation()
        rows = made if counted is None else made.observe(seen, F.count(F.lit(1)).alias("rows"))
        if layout.by:  # large partitions are split over tasks, small ones share one
            rows = rows.hint("rebalance", *[F.col(c) for c in layout.names])
        if layout.by or layout.sort:
            rows = rows.sortWithinPartitions(*layout.names, *layout.sort)
        root = f"{name}/{COMMIT}={uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*layout.names) if layout.by else rows.write
        writer.option("compression", "zstd").parquet(f"{self.folder}/{root}")
        if counted is not None:
            counted[name] = (observed(seen) or {"rows": 0})["rows"]
        parts: dict[str, list[str]] = {}
        level = [(root, [])]
        for c in layout.names:
            level = [(f"{at}/{n}", [*v, self._value(n.removeprefix(f"{c}="))]) for at, v in level for n in self._names(f"{self.folder}/{at}") if n.startswith(f"{c}=")]
        for at, v in level:
            parts[json.dumps(v)] = [at]
        return {"schema": made.schema.jsonValue(), "by": layout.names, "derived": layout.derived, "sort": list(layout.sort), "hidden": sorted(layout.derived), "parts": parts}

    def _names(self, at: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]

    def _value(self, text: str) -> str | None:
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return None if text == NULL else unescape(text)

    @staticmethod
    def _layout(table: dict | None, given: Layout | None) -> Layout:
        if table is None:
            return given or Layout()
        kept = Layout(tuple(f"{c}={table['derived'][c]}" if c in table["derived"] else c for c in table["by"]), tuple(table["sort"]))
        return given or kept

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, state: dict | None = None, fail_after: int | None = None, overwritten: dict[str, DataFrame] | None = None, emptied: dict[str, Iterable[dict]] | None = None, layouts: dict[str, Layout] | None = None, counted: dict[str, int] | None = None, before: Callable[[], object] | None = None) -> int:
        """Publish tables (and small state values) together.

        replaced: the whole table. appended: rows beside those there are. overwritten: the partitions that the rows have,
        and those named in `emptied`, give way to the rows; all other partitions keep their files. layouts: of new tables
        (a known table keeps its own unless it is replaced). counted: gets the rows written of each table, observed by the
        write itself. before: called when all is written and nothing shows; what it raises stops the commit. fail_after:
        raise after so many tables, for tests.
        """
        old, layouts = self.manifest(), layouts or {}
        version = (self.versions() or [0])[-1] + 1
        tables, done = dict(old["tables"]), 0
        for how, frames in (("replace", replaced or {}), ("append", appended or {}), ("overwrite", overwritten or {})):
            for name, df in frames.items():
                table = tables.get(name)
                layout = self._layout(table, layouts.get(name))
                if table and how != "replace" and layout != self._layout(table, None):
                    raise ValueError(f"{name} lies otherwise; replace it to change its layout")
                if how == "overwrite" and not layout.by:
                    raise ValueError(f"{name} has no partitions to overwrite")
                new = self._write(name, df, layout, counted)
                if table and how == "append":
                    new["parts"] = {k: [*table["parts"].get(k, []), *new["parts"].get(k, [])] for k in table["parts"] | new["parts"]}
                elif table and how == "overwrite":
                    gone = {json.dumps([_told(p[c]) for c in layout.names]) for p in (emptied or {}).get(name, [])}
                    new["parts"] = {k: v for k, v in table["parts"].items() if k not in gone} | new["parts"]
                tables[name] = new
                done += 1
                if fail_after is not None and done >= fail_after:
                    raise RuntimeError("stopped before publication")
        if before is not None:
            before()
        return self._publish({"tables": tables, "state": old["state"] | (state or {})}, version)

    def load_once(self, name: str, df: DataFrame, attempts: int = 3, wait: float = 1.0) -> bool:
        """Append a table's rows unless the same content was loaded before; whether it was appended. A failed attempt is
        made again, and looks first whether another writer has loaded the content meanwhile."""
        mark = f"load:{name}:{signature(df)}"
        for attempt in range(attempts):
            if mark in self.manifest()["state"]:
                return False
            try:
                self.commit(appended={name: df}, state={mark: 1})
                return True
            except ValueError:
                raise
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(wait * 2**attempt)
        return False

    def corrected(self, name: str, key: str, corrections: DataFrame, column: str) -> int:
        """A guarded correction in place: compare and swap.

        corrections: key, the values that are allowed `before` (an array), the value `after`. If every key is there once and
        its value is `after` or among those before, the rows that differ from `after` change, in their partitions only; else
        nothing does and a ValueError tells how many were off. Returns the number of rows changed; again, it is 0.
        """
        table = self.read(name)
        plan = corrections.select(key, "before", F.col("after").cast(table.schema[column].dataType).alias("after"))
        if plan.groupBy(key).count().where("count > 1").count():
            raise ValueError(f"{name}: a key is corrected twice")
        held = table.select(key, F.col(column).alias("_now"))
        at = plan.join(held, key, "left").withColumn("_ok", F.coalesce(F.col("_now").eqNullSafe(F.col("after")) | F.exists("before", lambda b: b.cast(table.schema[column].dataType) == F.col("_now")), F.lit(False)))
        found = at.agg(F.count_if("_ok").alias("ok"), F.count_if(F.col("_ok") & ~F.col("_now").eqNullSafe(F.col("after"))).alias("change"), F.count(F.lit(1)).alias("n")).first()
        expected = plan.count()
        if found.ok != expected or found.n != expected:
            raise ValueError(f"{name}: {found.ok} of {expected} rows are as expected; nothing was changed")
        if not found.change:
            return 0
        new = F.when(F.col("after").isNotNull(), F.col("after")).otherwise(F.col(column))
        old = self.manifest()["tables"][name]
        if not old["by"] or column in old["by"] or any(column in e for e in old["derived"].values()):
            swapped = table.join(plan.select(key, "after"), key, "left").withColumn(column, new).select(*table.columns)
            self.commit(replaced={name: swapped})
            return found.change
        layout = self._layout(old, None)
        full = table.withColumns({c: F.expr(e) for c, e in layout.derived.items()})
        touched = [r.asDict() for r in full.join(plan.select(key), key, "left_semi").select(*layout.names).distinct().collect()]  # at most a row a partition
        some = self.read(name, where={c: {r[c] for r in touched} for c in layout.names})
        swapped = some.join(plan.select(key, "after"), key, "left").withColumn(column, new).select(*table.columns)
        self.commit(overwritten={name: swapped})
        return found.change

    def dropped(self, name: str, ending: str = "_teste") -> None:
        """Remove the whole store, as before a scenario is run anew. name: the folder's own name, said again; it must have the
        ending of stores that may go."""
        own = self.folder.rsplit("/", 1)[-1]
        if name != own or not own.endswith(ending) or own == ending:
            raise ValueError(f"{own} isn't a store that may be dropped as {name}")
        self._fs.delete(self._path(self.folder), True)
        self._fs.mkdirs(self._path(f"{self.folder}/_versions"))

    # --- keeping house -------------------------------------------------------------------------------------------

    def compact(self, name: str, most: int = 8) -> int:
        """Rewrite the partitions that lie in more than `most` folders as one folder each; how many were."""
        table = self.manifest()["tables"][name]
        many = {k for k, v in table["parts"].items() if len(v) > most}
        if not many:
            return 0
        layout = self._layout(table, None)
        if not layout.by:
            self.commit(replaced={name: self.read(name)})
            return 1
        # whole partitions: their values are one folder list, read and put back as they are
        kind = T.StructType.fromJson(table["schema"])
        paths = [f"{self.folder}/{p}" for k in sorted(many) for p in table["parts"][k]]
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").schema(T.StructType([*kind.fields, T.StructField(COMMIT, T.StringType())])).parquet(*paths)
        self.commit(overwritten={name: rows.select(*[f.name for f in kind.fields if f.name not in table["hidden"]])})
        return len(many)

    def vacuum(self, keep: int = 10) -> int:
        """Remove all but the newest `keep` versions, and the folders that only they, or broken commits, hold; how many folders."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - max(1, keep))]:
            self._fs.delete(self._path(f"{self.folder}/_versions/{v}"), False)
        used = {p for v in self.versions() for t in self.manifest(v)["tables"].values() for ps in t["parts"].values() for p in ps}
        gone = 0
        for name in (n for n in self._names(self.folder) if not n.startswith(("_", "."))):
            for commit in self._names(f"{self.folder}/{name}"):
                inside = [p for p in used if p == f"{name}/{commit}" or p.startswith(f"{name}/{commit}/")]
                if not inside:
                    self._fs.delete(self._path(f"{self.folder}/{name}/{commit}"), True)
                    gone += 1
        return gone
