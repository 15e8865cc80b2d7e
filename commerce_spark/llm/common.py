"""Helpers that the training-data operators share: checkpoints, batches of rows, ranks and components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local
    mode, as in tests; on a cluster an error."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not told and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="llm-checkpoints-"))
        at = sc._jsc.sc().getCheckpointDir()
    return told or at.get()


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows (or fewer, where fewer are set) for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


BATCH = 4000  # rows of an Arrow batch in eager work: with whole texts, some megabytes on both sides


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    with batch_rows(df.sparkSession, BATCH):
        return df.checkpoint(eager=True)


def spare(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores behind it, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, mb: float = 16) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece has more than `rows` rows or about `mb` MB of `column` (one row at least)."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and _bytes(batch.column(k).slice(at, n)) > mb * (1 << 20):
                n //= 2
            yield batch.slice(at, n)
            at += n
    trim()


def trim() -> None:
    """Give memory that a task no longer uses back to the system: Python workers outlive their tasks, and the allocators
    under Arrow and numpy keep what was freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def _bytes(column: pa.Array) -> int:
    """The bytes of a string or binary column's values."""
    if not len(column):
        return 0
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    return int(offsets[-1] - offsets[0])


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of `many` each, one after another."""
    ends = np.cumsum(many, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - many), many)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row, and where each text starts (with the end); null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks_of(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None, keep: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Texts cut into chunks: an array of all chunks in a row, and the number of each text's.

    cut: the bytes that start a chunk, besides each text's first; None: blanks after anything but a blank. The
    byte of a cut is kept in its chunk or, as by default, left out.
    """
    if cut is None:
        cut = data == 32
        cut[1:] &= data[:-1] != 32
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[starts] = False
    begin = cut.copy()
    begin[starts] = True
    at = np.flatnonzero(begin)
    sizes = np.diff(np.append(at, len(data)))
    if not keep:
        sizes -= cut[at]
        data = data[~cut]
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), np.diff(np.searchsorted(at, offsets))


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind, room: int = 1 << 12):
        self.a, self.n = np.empty(room, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.a):
            bigger = np.empty(max(self.n + len(values), len(self.a) * 3 // 2), self.a.dtype)
            bigger[: self.n] = self.a[: self.n]
            self.a = bigger
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)


class Names:
    """Numbers strings from 0 on, exactly: an open-addressing table by 64-bit hash over their bytes, all in arrays."""

    def __init__(self):
        self.hash, self.at, self.size, self.bytes = Grown(np.uint64), Grown(np.int64), Grown(np.int32), Grown(np.uint8)
        self.table = np.full(1 << 16, -1, np.int32)

    def __len__(self) -> int:
        return self.hash.n

    def _same(self, found: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings `found` have the bytes given."""
        ok = self.size.a[found] == size
        some = np.flatnonzero(ok & (size > 0))
        if len(some):
            n = size[some]
            same = self.bytes.a[ranges(self.at.a[found[some]], n)] == data[ranges(at[some], n)]
            ok[some] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return ok

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - (len(self.table).bit_length() - 1))).astype(np.int64)

    def find(self, data: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The numbers of strings (bytes, starts with the end, hashes); -1 for those not held."""
        size, out = np.diff(at), np.full(len(h), -1, np.int64)
        slot, todo = self._first(h), np.arange(len(h))
        while len(todo):
            here = self.table[slot[todo]].astype(np.int64)
            full = here >= 0
            todo, here = todo[full], here[full]
            like = np.flatnonzero(self.hash.a[here] == h[todo])
            hit = np.zeros(len(todo), bool)
            hit[like] = self._same(here[like], data, at[todo[like]], size[todo[like]])
            out[todo[hit]] = here[hit]
            todo = todo[~hit]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        return out

    def add(self, data: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers for strings not held yet, all different."""
        new = self.hash.n + np.arange(len(h))
        self.at.add(self.bytes.n + at[:-1])
        self.size.add(np.diff(at))
        self.bytes.add(data)
        self.hash.add(h)
        if 2 * self.hash.n > len(self.table):
            self.table = np.full(1 << (4 * self.hash.n).bit_length(), -1, np.int32)
            self._place(np.arange(self.hash.n))
        else:
            self._place(new)
        return new

    def _place(self, number: np.ndarray) -> None:
        slot = self._first(self.hash.a[number])
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]  # of several, the last one stays
            left = self.table[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.table) - 1)


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, strings.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(strings))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links left-right, each node's smallest reachable node."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: long columns a, b (any order, repeats and loops allowed). Returns node, component (the smallest
    node reachable) for every node that a link touches. Each round is aggregations and joins on the node, so
    a hub is pre-aggregated and its join can be split; links never reach the driver. The rounds are
    logarithmic in the longest path; each ends in a checkpoint.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def offsets(df: DataFrame, group: list[str], lane: str, amounts: dict[str, str]) -> DataFrame:
    """Exclusive sums over lanes: for each group and lane, what earlier lanes of the group hold.

    amounts: result column -> SQL aggregate. The window sees one row per group and lane, never the rows.
    """
    from pyspark.sql import Window

    per = df.groupBy(*group, lane).agg(*[F.expr(v).alias(k) for k, v in amounts.items()])
    w = Window.partitionBy(*group).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*group, lane, *[F.coalesce(F.sum(k).over(w), F.lit(0)).cast("long").alias(f"{k}_before") for k in amounts])


_MEMBERS_BITS = 1 << 23


def members(refs: DataFrame) -> bytes:
    """A filter of fixed size (1 MB) that holds every ref (and may hold others): it spares work, never changes results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(_MEMBERS_BITS, np.uint8)
        for b in batches:
            field[_member_bits(np.asarray(b.column(0)))] = 1
        yield pa.record_batch([pa.array([np.packbits(field).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(_MEMBERS_BITS // 8, np.uint8)
    with batch_rows(refs.sparkSession, BATCH):
        for r in refs.coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():  # one field at a time
            out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _member_bits(refs: np.ndarray) -> np.ndarray:
    return (mix64(refs.astype(np.int64).view(U64)) % U64(_MEMBERS_BITS)).astype(np.int64)


def only_members(rows: DataFrame, bits: bytes) -> DataFrame:
    """Rows whose ref, the first column, the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(field[_member_bits(np.asarray(b.column(0)))]))

    return rows.mapInArrow(run, rows.schema)


def not_members(bits: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches the rows whose ref, the first column, the filter doesn't hold."""
    field = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    for b in batches:
        yield b.filter(pa.array(~field[_member_bits(np.asarray(b.column(0)))]))
