"""Vector code compression: every part of a vector becomes the number of its codebook's nearest entry, in exact integers.

The nearest entry is found from coarse to fine. For blocks of a part, the distance is at least the blocks' sizes times their
squared differences of means, plus the squared difference of what norms the means leave (Cauchy-Schwarz). Entries whose
bound, lowered by more than its rounding, exceeds the exact distance of the most promising entry can't be nearest; the
bound is refined over halved blocks for those left, and the survivors get exact integer distances.

Each task sums what it assigned before the shuffle: a round moves one row a task, part and entry, and the driver holds
the codebooks alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trim

BLOCK = 4096  # vectors at a time
LABELS = 1 << 17  # labels whose sums are broadcast at most (some 10 MB); more are joined by shuffle, in lanes
LANES = 32


def vectors(batch: pa.RecordBatch, k: int, scale: float, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors in column k that can take part (not null, not empty, all components finite), and their
    floor(scale * x) as rows; only those of `components` components, or where that is None, their numbers of components."""
    column = batch.column(k)
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = np.diff(at)
    x = column.values.slice(at[0], at[-1] - at[0])
    good = np.append(np.isfinite(x.fill_null(math.nan).to_numpy(zero_copy_only=False)), True).astype(np.int64)
    ok = np.asarray(column.is_valid()) & (size > 0)
    start = at[:-1] - at[0]
    total = np.concatenate(([0], np.cumsum(good)))
    ok &= total[start + size] - total[start] == size
    if components is None:
        return np.flatnonzero(ok), size[ok]
    ok &= size == components
    rows = np.flatnonzero(ok)
    values = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)[(start[rows][:, None] + np.arange(components)).reshape(-1)]
    whole = np.floor(scale * values)
    most = math.isqrt((2**63 - 1) // max(1, components)) // 2
    if len(whole) and np.abs(whole).max() > most:
        raise ValueError(f"a scaled component exceeds {most}: distances would not fit 64 bits")
    return rows, whole.astype(np.int64).reshape(len(rows), components)


def bounds_of(components: int) -> list[np.ndarray]:
    """Starts of the blocks of each level: one block, then halves, down to blocks of two or three components."""
    levels, n = [], 1
    while n == 1 or n * 2 <= components:
        levels.append(np.arange(n) * components // n)
        n *= 2
    return levels


class Sketch:
    """Block means of rows and the norms that they leave, at one level."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
        total = np.add.reduceat(x, starts, axis=1).astype(np.float64)
        self.mean = total / np.sqrt(size)  # so that squared differences are sizes times squared differences of means
        norm = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
        self.rest = np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", self.mean, self.mean), 0))
        self.slack = 1e-7 + 1e-12 * norm
        self.root = np.sqrt(self.slack)  # a norm that cancels out to rounding can be off by its root

    def bound(self, own: np.ndarray, other: Sketch, theirs: np.ndarray) -> np.ndarray:
        """Of pairs of rows, what their squared distance is at least."""
        r = np.maximum(np.abs(self.rest[own] - other.rest[theirs]) - (self.root[own] + other.root[theirs]), 0)
        out = r * r - (self.slack[own] + other.slack[theirs])
        for j in range(self.mean.shape[1]):
            d = self.mean[own, j] - other.mean[theirs, j]
            out += d * d
        return out


def nearest(x: np.ndarray, entries: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest entry (the lowest on a tie) and its exact squared distance. seen: gets the number
    of exact distances."""
    index, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    levels = bounds_of(x.shape[1])
    theirs = [Sketch(entries, s) for s in levels]
    every, columns, fields = np.arange(len(entries)), np.ascontiguousarray(x.T), np.ascontiguousarray(entries.T)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        own = Sketch(part, levels[0])
        coarse = own.bound(np.arange(len(part))[:, None], theirs[0], every[None, :])
        d = part - entries[coarse.argmin(axis=1)]
        best = np.einsum("ij,ij->i", d, d)
        row, entry = np.nonzero(coarse <= best[:, None])
        for starts, other in zip(levels[1:], theirs[1:], strict=True):
            fine = Sketch(part, starts).bound(row, other, entry)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            hit = np.flatnonzero(fine == np.minimum.reduceat(fine, first)[row])
            hit = hit[np.diff(row[hit], prepend=-1) > 0]  # each row's most promising entry now
            d = part - entries[entry[hit]]
            best = np.minimum(best, np.einsum("ij,ij->i", d, d))
            low = fine <= best[row]
            row, entry = row[low], entry[low]
        exact = np.zeros(len(row), np.int64)
        for j in range(part.shape[1]):
            d = columns[j][at : at + BLOCK][row] - fields[j][entry]
            exact += d * d
        if seen is not None:
            seen.append(len(exact))
        low = np.minimum.reduceat(exact, np.flatnonzero(np.diff(row, prepend=-1)))  # each row keeps its nearest entry at least
        hit = np.flatnonzero(exact == low[row])
        hit = hit[np.diff(row[hit], prepend=-1) > 0]
        index[at : at + BLOCK], dist[at : at + BLOCK] = entry[hit], low
    return index, dist


@dataclass(frozen=True)
class Codec:
    """Codebooks: books[part, entry, position]."""

    books: np.ndarray
    scale: float

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def main_size(vecs: DataFrame) -> int:
    """The most frequent number of components of vectors that can take part (the smaller on a tie; 0 without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            for n, many in zip(*np.unique(vectors(b, 0, 1.0)[1], return_counts=True), strict=True):
                total[int(n)] = total.get(int(n), 0) + int(many)
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["n", "many"])

    found = vecs.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "n long, many long").groupBy("n").agg(F.sum("many").alias("many")).orderBy(F.desc("many"), "n").first()
    return found.n if found else 0


def _first(vecs: DataFrame, components: int, entries: int, scale: float) -> np.ndarray:
    """The vectors of the smallest ids, ascending: of rows that share an id the smallest vector. A task sends `entries` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        for b in batches:
            rows, x = vectors(b, 1, scale, components)
            ids = np.asarray(b.column(0).take(pa.array(rows)).fill_null(2**63 - 1), np.int64)
            named = np.asarray(b.column(0).is_valid())[rows]
            ids, x = ids[named], x[named]
            if not len(ids):
                continue
            ids_here = np.unique(ids)[:entries]
            for k in np.flatnonzero(ids <= ids_here[-1]):
                i, v = int(ids[k]), x[k].tolist()
                if i not in best or v < best[i]:
                    best[i] = v
            best = {i: best[i] for i in sorted(best)[:entries]}
        yield pa.record_batch([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int64()))], ["vec_id", "v"])

    rows = vecs.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v array<long>")
    found = rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), components)


def fit(vecs: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codec | None:
    """Codebooks: first the parts of the smallest ids' vectors, then `rounds` times the floored means of what is nearest to
    each entry; an entry without any stays. None if no vector can take part."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number takes two hex digits")
    components = main_size(vecs)
    if not components:
        return None
    if components % parts:
        raise ValueError(f"{components} components can't be cut into {parts} equal parts")
    books = _first(vecs, components, entries, scale)
    if not len(books):
        raise ValueError("no vector has an id to start the codebooks with")
    books = np.ascontiguousarray(books.reshape(len(books), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(vecs, Codec(books, scale))
    return Codec(books, scale)


def _moved(vecs: DataFrame, codec: Codec) -> np.ndarray:
    """One round: assign all, then move every entry to the floored mean of its own."""
    parts, entries, w = codec.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, w), np.int64)
        for b in batches:
            _, x = vectors(b, 0, codec.scale, parts * w)
            for p in range(parts):
                part = x[:, p * w : p * w + w]
                index = nearest(part, codec.books[p])[0] + p * entries
                many += np.bincount(index, minlength=len(many))
                np.add.at(total, index, part)
        some = np.flatnonzero(many)
        yield pa.record_batch([pa.array(some), pa.array(many[some]), *[pa.array(total[some, j]) for j in range(w)]], ["cell", "many", *[f"t{j}" for j in range(w)]])
        trim()

    fields = ", ".join(["cell long", "many long", *[f"t{j} long" for j in range(w)]])
    sums = vecs.select(F.col("embedding").cast("array<double>")).mapInArrow(run, fields).groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("many", *[f"t{j}" for j in range(w)])])
    books = codec.books.copy().reshape(parts * entries, w)
    for r in sums.collect():  # a row an entry
        books[r.cell] = [int(r[f"t{j}"]) // int(r.many) for j in range(w)]
    return books.reshape(parts, entries, w)


def encode(vecs: DataFrame, codec: Codec) -> DataFrame:
    """vec_id, label, code, error of every vector that can take part and has the codebooks' number of components."""
    parts, entries, w = codec.books.shape
    kind = vecs.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors(b, 2, codec.scale, parts * w)
            code, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                index, dist = nearest(x[:, p * w : p * w + w], codec.books[p])
                code[:, p] = index
                error += dist
            digits, n = code.tobytes().hex(), 2 * parts
            take = pa.array(rows)
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array([digits[i * n : i * n + n] for i in range(len(rows))], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
        trim()

    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vecs: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that can take part.

    Left out are null and empty vectors, those with a null or non-finite component, and those of another than the most
    frequent number of components. Rows with a null id are encoded but never start a codebook; repeated rows are rows of
    their own; with fewer ids than entries the codebooks are shorter. Null labels count together. A component that no 64-bit
    distance could hold is an error. An empty table gives no rows. Columns but vec_id, label and embedding aren't looked at.
    """
    codec = fit(vecs, parts, entries, rounds, scale)
    spark = vecs.sparkSession
    if codec is None:
        kind = vecs.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(vecs, codec))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    if sums.count() <= LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:  # a label may have a third of all rows: its rows are dealt into lanes, its sum is sent to each
        lanes = sums.withColumn("_lane2", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
        dealt = coded.withColumn("_lane", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LANES)).cast("int"))
        out = dealt.join(lanes, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_lane") == F.col("_lane2")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(codec.sha256).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """DuckDB SQL of `compress` over the view embeddings, every distance of every entry."""
    out = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1) AS e, x AS c FROM (SELECT r, vec_id FROM kept ORDER BY vec_id LIMIT {entries}) JOIN cells USING (r))",
    ]
    nearest_ = "(SELECT r, p, min(struct_pack(d := list_sum(list_transform(x, lambda y, i: (y - c[i]) * (y - c[i])))::BIGINT, e := e)) AS best FROM cells JOIN book{k} USING (p) GROUP BY r, p)"
    for k in range(rounds):
        out.append(f"near{k} AS MATERIALIZED {nearest_.format(k=k)}")
        out.append(f"spread{k} AS (SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM near{k} JOIN cells USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM cells) + 1)) AS i) GROUP BY p, best.e, i)")
        out.append(f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS m FROM spread{k} GROUP BY p, e)")
        out.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    out.append(f"last AS MATERIALIZED {nearest_.format(k=rounds)}")
    out.append("coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r)")
    return f"""WITH {", ".join(out)}
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (r)"""
