"""Embedding near-duplicates with a forest of random-projection trees.

Equal vectors are one class from the start. Each tree halves the classes again and again along random directions;
classes near a threshold go to both sides (spill). Classes that share a leaf in any tree are compared by cosine in
double precision; a pair that shares several leaves counts in the first of them only, so that counts need no
list of pairs. Of the links of a leaf, only a spanning forest goes on to the union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_components
from .vectors import main_width, parse, stacked


class Forest:
    """Trees fitted on a bounded sample of unit vectors.

    Thresholds are the medians of the sample's projections; a node with fewer than `leaf` sample vectors is a
    leaf. The margin of spill is `spill` times the spread, along a random direction, of two vectors at the
    given cosine. Nodes are numbered as in a heap, leaves over all trees.
    """

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, cosine: float, spill: float, seed: int = 0, depth: int = 24):
        self.width = sample.shape[1]
        self.margin = spill * np.sqrt(max(2 * (1 - cosine), 0) / max(self.width, 1))
        rng = np.random.default_rng(seed)
        self.directions, self.thresholds = [], []
        for _ in range(trees):
            dirs = rng.standard_normal((depth, self.width))
            dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
            cuts: dict[int, float] = {}
            level = {1: np.arange(len(sample))}
            for d in range(depth):
                below: dict[int, np.ndarray] = {}
                proj = sample @ dirs[d]
                for node, rows in level.items():
                    if len(rows) <= leaf:
                        continue
                    t = float(np.median(proj[rows]))
                    left, right = rows[proj[rows] < t], rows[proj[rows] >= t]
                    if not len(left) or not len(right):
                        continue
                    cuts[node] = t
                    below[2 * node], below[2 * node + 1] = left, right
                level = below
                if not level:
                    break
            self.directions.append(dirs)
            self.thresholds.append(cuts)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, each once, sorted by row and leaf."""
        rows, leaves = [], []
        for t, (dirs, cuts) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            row, node, d = np.arange(len(x)), np.ones(len(x), np.int64), 0
            while len(row):
                names, at = np.unique(node, return_inverse=True)
                cut_at = np.array([cuts.get(int(k), np.nan) for k in names])[at]
                done = np.isnan(cut_at)
                rows.append(row[done])
                leaves.append((t << 48) + node[done])
                row, node, cut_at = row[~done], node[~done], cut_at[~done]
                if not len(row):
                    break
                p = x[row] @ dirs[d]
                left, right = p < cut_at + self.margin, p >= cut_at - self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
                d += 1
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _compare(rep: np.ndarray, copies: np.ndarray, x: np.ndarray, trails: list[bytes], side: np.ndarray, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one unit of work: a link of the spanning forest (or the row itself) and the copies linked, for each row with links."""
    n = len(rep)
    norm = np.sqrt((x * x).sum(axis=1))
    earlier = [np.frombuffer(t, np.int64) for t in trails]
    earlier = [t[t < leaf] for t in earlier]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True) if sum(map(len, earlier)) else (np.empty(0), np.empty(0, int))
    member = np.zeros((n, len(names)), np.float32)
    member[np.repeat(np.arange(n), [len(t) for t in earlier]), at] = 1
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    count = np.zeros(n, np.int64)
    left, right = [], []
    for s in range(0, len(first), 512):
        a = first[s : s + 512]
        close = (x[a] @ x[second].T) / (norm[a][:, None] * norm[second]) >= cosine
        if second is first or not side.any():
            close &= a[:, None] < second[None, :]
        if not close.any():
            continue
        close &= (member[a] @ member[second].T) == 0
        i, j = np.nonzero(close)
        i, j = a[i], second[j]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        left.append(i)
        right.append(j)
    if not left:
        return rep[:0], rep[:0], count[:0]
    label = local_components(n, np.concatenate(left), np.concatenate(right))
    found = np.flatnonzero(count)
    return rep[found], rep[label[found]], count[found]


def classes(df: DataFrame, cosine: float = 0.95, trees: int = 8, leaf: int = 64, spill: float = 0.25, sample_rows: int = 16384, block_rows: int = 1024, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, or are not of the most frequent
    length, link with nothing: no links, a component of their own. Copies link with each other. Repeated
    vec_ids are rows of their own; a null vec_id takes no part. Leaves of over `block_rows` classes are cut into
    blocks and compared block by block, so that no task holds more than two blocks.
    """
    spark = df.sparkSession
    vecs = parse(df, id_col, column)
    width = main_width(vecs)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([xxhash.xxh3_128_digest(v) for v in raw], pa.binary()), b.column(1)], ["vec_id", "key", "vec"])

    usable = vecs.where((F.octet_length("vec") == 8 * width) & (F.regexp_replace(F.hex("vec"), "^(0000000000000000|0000000000000080)*$", "") != ""))
    keyed = usable.mapInArrow(key, "vec_id long, key binary, vec binary")
    reps = cut(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    total = reps.count()
    sample = reps.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("vec").collect()
    x = np.array([np.frombuffer(r.vec) for r in sample]).reshape(len(sample), width)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x
    forest = Forest(x, trees if total else 0, max(8, leaf * len(x) // max(total, 1)), cosine, spill)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = stacked(b.column(2), width)
            row, leaves = forest.leaves(raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)))
            ends = np.searchsorted(row, np.arange(len(raw) + 1))
            trails = [leaves[ends[i] : ends[i + 1]].tobytes() for i in range(len(raw))]
            for s in range(0, len(row), 8192):
                r = pa.array(row[s : s + 8192])
                yield pa.record_batch([pa.array(leaves[s : s + 8192]), b.column(0).take(r), b.column(1).take(r), b.column(2).take(r), pa.array([trails[i] for i in row[s : s + 8192]], pa.binary())], ["leaf", "rep", "copies", "vec", "trail"])

    dealt = reps.select("rep", "copies", "vec").mapInArrow(assign, "leaf long, rep long, copies long, vec binary, trail binary") if total else spark.createDataFrame([], "leaf long, rep long, copies long, vec binary, trail binary")
    sizes = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    parts = [(r.leaf, -(-r.n // block_rows)) for r in sizes.collect()]  # at most one entry for each leaf of the forest
    table = F.broadcast(spark.createDataFrame(parts, "leaf long, parts int"))
    split = dealt.join(table, "leaf", "left").withColumn("mine", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.lit(0)))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    units = split.select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "copies", "vec", "trail")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            a, b, n = _compare(np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.frombuffer(b"".join(h[3] for h in held)).reshape(-1, width), [h[4] for h in held], np.array([h[0] for h in held]), now[0], cosine)
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for leaf_, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if held and (leaf_, i, j) != now:
                    yield done()
                    held = []
                now = (leaf_, i, j)
                held.append(rest)
        if held:
            yield done()

    found = cut(units.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "rep").mapInArrow(compare, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = components(found.select("a", "b"))
    per = reps.join(counts, "rep", "left").join(named, reps.rep == named.node, "left")
    per = per.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("vec_id", "key").join(per, "key").select("vec_id", "n_links", "component_id")
    own = F.col(id_col).cast("long")
    whole = F.col(column).cast("array<double>")
    lame = F.coalesce((F.size(whole) != width) | ~F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) | F.forall(whole, lambda v: v == 0), F.lit(True))
    alone = df.where(own.isNotNull() & lame).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
