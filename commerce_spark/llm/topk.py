"""Exact top-k search by inner product with a pivot-distance index.

Vectors are quantised to integers and lifted by one coordinate so that all have the norm of the longest; then a larger
inner product is a smaller distance. Each vector is keyed by its nearest pivot and its distance to it, cut into rings.
A query knows its distance to every pivot, so the triangle inequality bounds the inner products of a ring's vectors.
First the query's best rings are searched until they hold k candidates; the k-th score found then stops
the search: only rings (and, in them, blocks) whose bound reaches it are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, cut
from .vectors import main_width, parse, stacked

SLACK = 1e-9


def quantise(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) in double precision, as whole numbers kept in doubles."""
    return np.floor(scale * x)


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by doubles where those are exact, else by Python's integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return (np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T).astype(np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots."""
    picked = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


class Index:
    """The index of a table: vecs (vec_id, vec as quantised doubles), pivots, ring edges and the rings' bounds.

    The driver holds pivots x rings entries. Pivots and edges are fitted on at most `sample_rows` vectors;
    every vector is indexed.
    """

    def __init__(self, vecs: DataFrame, scale: float = 256.0, pivots: int = 32, rings: int = 16, sample_rows: int = 2048, block_rows: int = 1024):
        self.spark, self.block_rows, self.rings = vecs.sparkSession, block_rows, rings
        self.width = width = main_width(vecs)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = quantise(stacked(b.column(1), width), scale)
                yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array((q * q).sum(axis=1))], ["vec_id", "vec", "norm2"])

        self.vecs = cut(vecs.where(F.octet_length("vec") == 8 * width).mapInArrow(whole, "vec_id long, vec binary, norm2 double"))
        self.norm2 = float(self.vecs.agg(F.max("norm2")).first()[0] or 0.0)
        sample = self.vecs.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample_rows).collect()
        lifted = _lift(np.array([np.frombuffer(r.vec) for r in sample]).reshape(len(sample), width), self.norm2)
        self.pivots = choose_pivots(lifted, pivots) if len(sample) else np.zeros((0, width + 1))
        d = _distances(lifted, self.pivots)
        near = d.argmin(axis=1) if len(sample) else np.zeros(0, int)
        self.edges = np.array([np.quantile(d[near == p, p], np.arange(1, rings) / rings) if (near == p).any() else np.zeros(rings - 1) for p in range(len(self.pivots))]).reshape(-1, rings - 1)
        place = self._place()
        keyed = self.vecs.mapInArrow(place, "vec_id long, vec binary, ring int, dist double")
        bounds = keyed.groupBy("ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("ring").collect()
        self.ring = np.array([r.ring for r in bounds], np.int64)
        self.low, self.high, self.n = (np.array([r[k] for r in bounds], float) for k in ("low", "high", "n"))
        self.blocks = self._pack(keyed, {int(r.ring): -(-r.n // block_rows) for r in bounds})

    def _place(self):
        pivots, edges, rings, norm2, width = self.pivots, self.edges, self.rings, self.norm2, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _distances(_lift(stacked(b.column(1), width), norm2), pivots)
                near = d.argmin(axis=1) if len(d) else np.zeros(0, int)
                dist = d[np.arange(len(d)), near]
                ring = near * rings + (dist[:, None] > edges[near]).sum(axis=1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(ring.astype(np.int32)), pa.array(dist)], ["vec_id", "vec", "ring", "dist"])

        return run

    def _pack(self, keyed: DataFrame, parts: dict[int, int]) -> DataFrame:
        """Blocks of a ring's vectors: ring, part, low, high, ids, vecs. A ring has as many parts as its size asks for,
        so that a ring of copies is many blocks of bounded size, and no key of a join."""
        rows = self.block_rows * 2
        self.parts = self.spark.createDataFrame(list(parts.items()), "ring int, parts int")  # a row for each ring
        dealt = keyed.join(F.broadcast(self.parts), "ring").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for b in batches:
                for ring, part, dist, i, vec in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if held and ((ring, part) != key or len(held) == rows):
                        yield _block(key, held)
                        held = []
                    key = (ring, part)
                    held.append((dist, i, vec))
            if held:
                yield _block(key, held)

        ordered = dealt.select("ring", "part", "dist", "vec_id", "vec").repartition("ring", "part").sortWithinPartitions("ring", "part", "dist", "vec_id")
        return cut(ordered.mapInArrow(run, "ring int, part int, low double, high double, ids binary, vecs binary"))

    def pruned(self, vectors: np.ndarray, floors: np.ndarray) -> float:
        """The share of the index's vectors that lie in rings which the bounds rule out, for queries with these floors."""
        bound, of, rings = self._bound()
        q2, lifted = of(vectors)
        top = bound(q2[:, None], _distances(lifted, self.pivots)[:, self.ring // rings], self.low, self.high)
        return float(((top < floors[:, None]) * self.n).sum() / (self.n.sum() * max(len(vectors), 1)))

    def search(self, queries: DataFrame, k: int = 5, query_rows: int = 256) -> DataFrame:
        """query_id, vec_id, score and rank: the k best other vectors of each query, ties to the smaller vec_id.

        queries: vec_id of indexed vectors. A query doesn't find rows that have its own id.
        """
        if not len(self.ring):
            return self.spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
        mine = self.vecs.join(queries.select("vec_id").distinct(), "vec_id").select("vec_id", "vec").dropDuplicates(["vec_id"])
        order, bound = self._order(), self._bound()
        first = mine.withColumn("floor", F.lit(None).cast("long")).withColumn("seen", F.lit(0)).mapInArrow(order(k, True), "ring int, query_id long, vec binary, floor long, seen int")
        found = cut(self._best(self._scan(first, bound, k, query_rows), k))
        floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        rest = mine.join(floors, mine.vec_id == floors.query_id, "left").select("vec_id", "vec", "floor", F.lit(1).alias("seen"))
        rest = rest.mapInArrow(order(k, False), "ring int, query_id long, vec binary, floor long, seen int")
        more = self._scan(rest, bound, k, query_rows)
        return self._best(found.select("query_id", "vec_id", "score").unionByName(more), k)

    def _bound(self):
        """Upper bounds of inner products, from distances to pivots and rings' distances."""
        norm2, rings = self.norm2, self.rings

        def bound(q2: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            gap = np.maximum(np.maximum(low - d, d - high), 0)
            gap = np.maximum(gap * (1 - SLACK) - SLACK * np.sqrt(norm2 + q2), 0)
            return (norm2 + q2 - gap * gap) / 2 + SLACK * (norm2 + q2) + SLACK

        def of(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (vec * vec).sum(axis=1), np.concatenate([vec, np.zeros((len(vec), 1))], axis=1)

        return bound, of, rings

    def _order(self):
        """Rings that a query visits, best bounds first: those it starts with, or the others that its floor lets in."""
        pivots, ring, low, high, n, width = self.pivots, self.ring, self.low, self.high, self.n, self.width
        bound, of, rings = self._bound()

        def make(k: int, start: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    vec = stacked(b.column(1), width)
                    q2, lifted = of(vec)
                    d = _distances(lifted, pivots)[:, ring // rings]
                    top = bound(q2[:, None], d, low, high)
                    at = np.argsort(-top, axis=1, kind="stable")
                    before = np.cumsum(n[at], axis=1) - n[at]
                    opens = before < k + 1  # one more: the query itself may be among them
                    if start:
                        row, col = np.nonzero(opens)
                    else:
                        floor = np.array([-np.inf if f is None else f for f in b.column(2).to_pylist()])
                        row, col = np.nonzero(~opens & (np.take_along_axis(top, at, axis=1) >= floor[:, None]))
                    for s in range(0, len(row), 4096):
                        r = pa.array(row[s : s + 4096])
                        yield pa.record_batch([pa.array(ring[at[row[s : s + 4096], col[s : s + 4096]]].astype(np.int32)), b.column(0).take(r), b.column(1).take(r), b.column(2).take(r), b.column(3).take(r)], ["ring", "query_id", "vec", "floor", "seen"])

            return run

        return make

    def _scan(self, visits: DataFrame, bounds, k: int, query_rows: int) -> DataFrame:
        """The k best of each block for each visiting query; visits travel in blocks of queries of one ring."""
        width, pivots, rings = self.width, self.pivots, self.rings
        bound, of, _ = bounds
        lanes = 8

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for b in batches:
                for ring, part, i, vec, floor in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    if held and ((ring, part) != key or len(held) == query_rows):
                        yield _queries(key, held)
                        held = []
                    key = (ring, part)
                    held.append((i, vec, -np.inf if floor is None else floor))
            if held:
                yield _queries(key, held)

        meets = visits.join(F.broadcast(self.parts), "ring").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = meets.withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(lanes))).repartition("ring", "part", "lane").sortWithinPartitions("ring", "part", "query_id")
        asked = dealt.select("ring", "part", "query_id", "vec", "floor").mapInArrow(pack, "ring int, part int, query_ids binary, query_vecs binary, floors binary")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ring, ids, vecs, low, high, query_ids, query_vecs, floors in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                    ids, query_ids, floors = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64), np.frombuffer(floors)
                    q, x = np.frombuffer(query_vecs).reshape(-1, width), np.frombuffer(vecs).reshape(-1, width)
                    q2, lifted = of(q)
                    d = _distances(lifted, pivots[ring // rings : ring // rings + 1])[:, 0]
                    open_ = np.flatnonzero(bound(q2, d, low, high) >= floors)
                    if not len(open_):
                        continue
                    s = _dot(q[open_], x)
                    own = query_ids[open_][:, None] == ids[None, :]
                    found = [[], [], []]
                    order = np.argsort(ids, kind="stable")
                    s, own = s[:, order], own[:, order]
                    for i in range(len(open_)):
                        ok = np.flatnonzero(~own[i] & (s[i] >= floors[open_[i]]))
                        if len(ok) > k:
                            kth = np.partition(s[i, ok], len(ok) - k)[len(ok) - k]
                            ok = ok[s[i, ok] >= kth]
                            ok = ok[np.argsort(-s[i, ok], kind="stable")[:k]]
                        found[0].append(np.full(len(ok), query_ids[open_[i]]))
                        found[1].append(ids[order[ok]])
                        found[2].append(s[i, ok])
                    yield pa.record_batch([pa.array(np.concatenate(f).astype(np.int64)) for f in found], ["query_id", "vec_id", "score"])

        pairs = self.blocks.join(asked, ["ring", "part"]).select("ring", "ids", "vecs", "low", "high", "query_ids", "query_vecs", "floors")
        with batch_rows(self.spark, 16):
            return cut(pairs.mapInArrow(score, "query_id long, vec_id long, score long"))

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(key: tuple[int, int], held: list) -> pa.RecordBatch:
    ids = np.array([h[1] for h in held], np.int64)
    return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held[0][0]], pa.float64()), pa.array([held[-1][0]], pa.float64()), pa.array([ids.tobytes()], pa.binary()), pa.array([b"".join(h[2] for h in held)], pa.binary())], ["ring", "part", "low", "high", "ids", "vecs"])


def _queries(key: tuple[int, int], held: list) -> pa.RecordBatch:
    ids, floors = np.array([h[0] for h in held], np.int64), np.array([h[2] for h in held], float)
    return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([b"".join(h[1] for h in held)], pa.binary()), pa.array([floors.tobytes()], pa.binary())], ["ring", "part", "query_ids", "query_vecs", "floors"])


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, **index) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query in `queries` (vec_id) against all rows of df.

    Vectors that are null, empty, or hold null or non-finite components take no part, neither as queries nor as
    candidates; nor do vectors of another length than most have. Ties go to the smaller vec_id; a query with
    fewer other rows than k gets them all; an empty table gives no rows.
    """
    found = Index(parse(df), scale, **index).search(queries, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
