"""SimHash near-duplicates with pigeonring candidates.

Fingerprints are 64 bits wide, from XXH64 hashes of word shingles. Two fingerprints link at `max_bits` or
fewer differing bits. The 64 bits are cut into `m` segments on a ring; if the differences of all segments sum to
at most t, some start has, for every chain length l, at most floor(l*t/m) differences in its first l segments
(the strong form of the pigeonhole principle). The leading segments whose budget is zero are equal, and so
form the join key; the longer chains prune what meets under a key; survivors get the full Hamming check.

Texts of a Jaccard similarity of 0.8 differ in some 10 of 64 bits: too many for equal segments. For them fingerprints are
560 bits wide (40 segments of 14), the radius is three standard deviations beyond the mean, a pair meets where any one
segment is equal, chains prune from there, and what is left is checked by the whole sets of shingles. A pair without an equal
segment, or with chains over budget from each, is missed: some 3 % at a similarity of 0.80, below 1 % from 0.85 on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, local_components, members, mix64, only_members, pieces, spare, width

SEED = 42


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; none if it has no word.

    A-Z are lower-cased, words are split at ASCII white space; a text of fewer words is one shingle.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    n = max(1, len(split) - words + 1)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_digest
    found = b"".join([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(split) - n :].tolist(), strict=True)])
    return np.frombuffer(found, ">u8").astype(np.uint64)


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits of a fingerprint of 64 * `words` bits, highest first: 1 if set in over half the hashes. The first 64 are
    of the hashes themselves, the others of hashes made from them."""
    ones = np.zeros(64 * words, np.int64)
    for s in range(0, len(h), 255):  # sums of up to 255 bits stay in a byte
        part = h[s : s + 255]
        wide = np.empty((len(part), words), ">u8")
        wide[:, 0] = part
        with np.errstate(over="ignore"):
            for k in range(1, words):
                wide[:, k] = mix64(part + np.uint64(k * 0xD1342543DE82EF95 & (1 << 64) - 1))
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * ones > len(h)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text as an unsigned integer; zero if it has no word."""
    return int.from_bytes(np.packbits(majority(shingle_hashes(text, words))).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def layout(max_bits: int, segments: int | None = None) -> tuple[int, list[int], int]:
    """Segments, the budget of each chain length, and the number of leading segments that must be equal."""
    m = segments or (8 if max_bits < 8 else max_bits + 1)
    if not max_bits < m <= 64:
        raise ValueError("more segments than max_bits are needed, 64 at most")
    budget = [ell * max_bits // m for ell in range(1, m + 1)]
    return m, budget, sum(b == 0 for b in budget)


def _cuts(m: int) -> list[int]:
    return [round(64 * i / m) for i in range(m + 1)]


def _turned(fp: np.ndarray, start: int, m: int) -> np.ndarray:
    """fp rotated so that segment `start` comes first (highest)."""
    by = _cuts(m)[start]
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _chain_widths(start: int, m: int) -> list[int]:
    """Bits in the chains of length 1..m from `start`."""
    at = _cuts(m)
    sizes = [at[i + 1] - at[i] for i in range(m)]
    return np.cumsum([sizes[(start + i) % m] for i in range(m)]).tolist()


def linked(fp: np.ndarray, other: np.ndarray, start: int, m: int, budget: list[int]) -> np.ndarray:
    """Positions at which fp and other pass every chain from `start`, and so the full check."""
    alive = np.arange(len(fp))
    diff = _turned(fp ^ other, start, m)
    widths = _chain_widths(start, m)
    for k in range(m):  # a longer chain with the same budget implies the shorter one
        if k + 1 < m and budget[k + 1] == budget[k]:
            continue
        ok = np.bitwise_count(diff >> np.uint64(64 - widths[k])) <= budget[k]
        alive, diff = alive[ok], diff[ok]
        if not len(alive):
            break
    return alive


def _keys(fps: DataFrame, max_bits: int, segments: int | None) -> DataFrame:
    """One row for each fingerprint and start: bucket (the start and the segments that must be equal)."""
    m, _, equal = layout(max_bits, segments)
    at = _cuts(m)
    parts = []
    for s in range(m):
        turned = F.col("fp") if at[s] == 0 else F.shiftleft("fp", at[s]).bitwiseOR(F.shiftrightunsigned("fp", 64 - at[s]))
        bits = _chain_widths(s, m)[equal - 1]
        parts.append(F.struct(F.lit(s).alias("start"), F.shiftrightunsigned(turned, 64 - bits).alias("key")))
    return fps.select("fp", F.inline(F.array(*parts)))


def links(fps: DataFrame, max_bits: int = 2, segments: int | None = None, bucket_rows: int = 4096) -> DataFrame:
    """A forest (a, b) that connects exactly those distinct fingerprints that links connect.

    fps: column fp, distinct. Buckets with at most `bucket_rows` fingerprints are compared in one task, chains
    first. A larger bucket is cut into blocks of about that many fingerprints and each pair of blocks is one
    unit of work, so that no task holds more than two blocks. In place of all links of a bucket only its
    spanning forest goes on.
    """
    m, budget, _ = layout(max_bits, segments)
    keys = _keys(fps, max_bits, segments)
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keys.join(sizes, ["start", "key"])
    blocks = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # a block meets every block, itself included: unit (i, j) with i <= j holds the rows of both
    dealt = sized.select("start", "key", "fp", blocks.alias("blocks"), mine.alias("mine"))
    small = dealt.where("blocks = 1").select("start", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(0).alias("side"))
    big = dealt.where("blocks > 1").select("start", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    big = big.select("start", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(rows, m, budget)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(6)], axis=1)
            last = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            whole = (rows[:, :4] == rows[-1, :4]).all(axis=1).all()
            if held and (held[-1][-1, :4] != rows[0, :4]).any():
                yield done(np.concatenate(held))
                held = []
            if whole or not len(last):
                held.append(rows)
                continue
            yield done(np.concatenate([*held, rows[: last[-1] + 1]]))
            held = [rows[last[-1] + 1 :]]
        if held:
            yield done(np.concatenate(held))

    units = small.unionByName(big).repartition("start", "key", "i", "j").sortWithinPartitions("start", "key", "i", "j", "fp")
    return units.mapInArrow(run, "a long, b long").distinct()


def _forest(rows: np.ndarray, m: int, budget: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in runs of equal (start, key, i, j); rows are sorted by them."""
    fp = rows[:, 4].copy().view(np.uint64)
    run = np.concatenate(([0], np.cumsum((rows[1:, :4] != rows[:-1, :4]).any(axis=1))))
    n = len(rows)
    left, right = [], []
    lag, at = 1, np.arange(n - 1)
    own_pairs = rows[:, 2] == rows[:, 3]  # a unit of two blocks has the pairs across them alone
    while len(at):
        at = at[run[at] == run[np.minimum(at + lag, n - 1)]]
        at = at[at + lag < n]
        if not len(at):
            break
        meet = at[own_pairs[at] | (rows[at, 5] != rows[at + lag, 5])]
        for s in range(m):
            own = meet[rows[meet, 0] == s]
            if len(own):
                ok = own[linked(fp[own], fp[own + lag], s, m, budget)]
                left.append(ok)
                right.append(ok + lag)
        lag += 1
        at = at[at + lag < n]
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    label = local_components(n, left, right)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def classes(docs: DataFrame, words: int = 3, max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links) of every document.

    Equal fingerprints are one node from the start, so copies make no pairs. Null and empty texts have the
    fingerprint zero, which links like any other. Repeated doc_ids give repeated rows; a null doc_id takes part
    but never names a component unless its component has no other.
    """
    found = cut(fingerprints(docs, words))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = cut(nodes)
    joined = components(links(nodes.select("fp"), max_bits, segments))
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return found.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def radius(similarity: float, bits: int, slack: float = 3.0) -> int:
    """Differing bits that sets of a Jaccard similarity, or more, keep within: the mean of a SimHash (the angle between
    the sets over pi, for sets of one size) and `slack` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + slack * math.sqrt(bits * share * (1 - share)))


SEGMENTS, SEGMENT_BITS = 40, 14  # of wide fingerprints


def _wide(h: np.ndarray) -> bytes | None:
    """A wide fingerprint: its segments as 16-bit numbers; None for no shingle."""
    if not len(h):
        return None
    bits = majority(h, -(-SEGMENTS * SEGMENT_BITS // 64))[: SEGMENTS * SEGMENT_BITS].reshape(SEGMENTS, SEGMENT_BITS)
    return (bits @ (1 << np.arange(SEGMENT_BITS))).astype("<u2").tobytes()


def _spanning(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Links (by place) of a spanning forest of least weight: each part takes its lightest link, until none is left."""
    order = np.argsort(weight, kind="stable")
    left, right = left[order], right[order]
    part, chosen, open_ = np.arange(n), [], np.arange(len(order))
    while len(open_ := open_[part[left[open_]] != part[right[open_]]]):
        a, b = part[left[open_]], part[right[open_]]
        best = np.full(n, len(order))
        np.minimum.at(best, a, open_)
        np.minimum.at(best, b, open_)
        pick = np.unique(best[best < len(order)])
        chosen.append(pick)
        part = local_components(n, part[left[pick]], part[right[pick]])[part]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)


def _closest(run: np.ndarray, start: np.ndarray, own_pairs: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of least difference of the pairs that pass all chains, in runs of equal `run`. Rows are sorted by
    it; fp has a row of segments for each."""
    n, m = fp.shape
    kept: list[np.ndarray] = []
    size, lag, at = 0, 1, np.arange(n - 1)

    def reduced() -> np.ndarray:
        every = np.concatenate(kept, axis=1)
        return every[:, _spanning(n, *every)]

    while len(at := at[at + lag < n]):
        at = at[run[at] == run[at + lag]]
        alive = at[own_pairs[at] | (side[at] != side[at + lag])]
        differ = np.zeros(len(alive), np.int64)
        for k in range(m):
            seg = (start[alive] + k) % m
            differ += np.bitwise_count(fp[alive, seg] ^ fp[alive + lag, seg])
            ok = differ <= budget[k]
            alive, differ = alive[ok], differ[ok]
        if len(alive):
            kept.append(np.stack([alive, alive + lag, differ]))
            size += len(alive)
        if size > 1 << 18:
            kept = [reduced()]
            size = kept[0].shape[1] // 2
        lag += 1
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = reduced()
    return found[0], found[1]


def near(nodes: DataFrame, similarity: float, bucket_rows: int = 2048) -> DataFrame:
    """Pairs (a, b) of nodes whose wide fingerprints are within `radius` and have an equal segment from which on all
    chains keep their budgets: of each bucket of an equal segment a spanning forest of the least differences.

    nodes: node, fp. Such a forest joins at every radius what all pairs of that radius join; so a later check of each of its
    pairs loses little (only where a farther pair of fingerprints is the more similar pair of texts).
    """
    limit = radius(similarity, SEGMENTS * SEGMENT_BITS)
    budget = [ell * limit // SEGMENTS for ell in range(1, SEGMENTS + 1)]
    spark = nodes.sparkSession
    at = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    keys = nodes.where("fp is not null").select("node", "fp", F.explode(at).alias("start")).withColumn("key", F.expr("cast(conv(hex(substring(fp, 2 * start + 1, 2)), 16, 10) as int)"))
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    sizes = cut(sizes.select("start", "key", F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int").alias("blocks")))
    few = sizes.count() <= 1 << 18  # some 10 MB: beyond, the join is dealt by bucket
    dealt = keys.join(F.broadcast(sizes) if few else sizes, ["start", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # a block meets every block, itself included: unit (i, j) with i <= j holds the rows of both
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    units = dealt.select("start", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            start, key, i, j, side, node = (rows.column(k).to_numpy().astype(np.int64) for k in range(6))
            fp = np.frombuffer(b"".join(rows.column(6).to_pylist()), "<u2").reshape(len(node), SEGMENTS)
            run = np.concatenate(([0], np.cumsum((np.diff(start) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))))
            a, b = _closest(run, start, i == j, side, fp, budget)
            a, b = node[a], node[b]
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            while batch.num_rows:
                last = held[-1] if held else None
                if last is not None and sum(b.num_rows for b in held) >= 2 * bucket_rows:
                    tail = tuple(last.column(k)[last.num_rows - 1].as_py() for k in range(4))
                    same = np.logical_and.reduce([batch.column(k).to_numpy() == tail[k] for k in range(4)])
                    n = int(np.argmin(same)) if not same.all() else len(same)
                    if n:
                        held.append(batch.slice(0, n))
                        batch = batch.slice(n)
                        continue
                    yield done()
                    held = []
                take = min(batch.num_rows, 2 * bucket_rows)
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
        if held:
            yield done()

    units = units.repartition(width(spark), "start", "key", "i", "j").sortWithinPartitions("start", "key", "i", "j")
    return units.mapInArrow(run, "a long, b long").distinct()


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """node, n and tokens (distinct shingles, sorted) of rows (node, text), one for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", mb=4):
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["node", "tokens"])

    return rows.mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose shingle sets have that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y))
                keep.append(both >= (similarity - 1e-12) * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable through links) of every document.

    Links are pairs of texts whose sets of word shingles have that Jaccard similarity or more: candidates come from wide
    fingerprints (`near`), and each is checked by the whole sets. Texts with the same set are one node from the start, those
    without a word too; no other text links with the latter. Repeated doc_ids give repeated rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("ref", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", mb=4):
            found = [shingle_hashes(t, words) for t in b.column(2).to_pylist()]
            node = [xxhash.xxh3_64_intdigest(np.unique(h).tobytes(), SEED) for h in found]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array([_wide(h) for h in found], pa.binary())], ["doc_id", "ref", "node", "fp"])

    found = cut(rows.select("doc_id", "ref", "text").mapInArrow(run, "doc_id long, ref long, node long, fp binary"))
    nodes = cut(found.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("ref").alias("ref"), F.first("fp").alias("fp")))
    pairs = cut(near(nodes.select("node", "fp"), similarity))
    touched = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(touched.join(nodes.select("node", "ref"), "node").select("ref", "node"))
    texts = only_members(rows.select("ref", "text"), members(wanted.select("ref"))).join(wanted, "ref").select("node", "text")
    joined = components(similar(pairs, cut(_sets(texts, words)), similarity))
    named = nodes.select("node", "low").join(joined, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return found.select("doc_id", "node").join(named.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents whose doc_id is the smallest of their class (see `similar_classes`), columns as they were; of rows
    that repeat such a doc_id the one whose text comes first stays, and documents without doc_id stay."""
    known = docs.where("doc_id is not null")
    kept = similar_classes(known.select("doc_id", "text"), words, similarity).where("doc_id = component_id").select("doc_id").distinct()
    rest = [F.col(c).cast("string").asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *rest)
    at = spare(docs, "_at")
    one = known.join(kept, "doc_id").select(docs.columns).withColumn(at, F.row_number().over(first)).where(F.col(at) == 1).select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
