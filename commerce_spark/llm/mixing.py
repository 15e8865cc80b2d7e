"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hashed order and epoch after epoch, are one stream of bytes, cut into blocks. A source of
weight w (the weights add up to 1) releases its k-th block (from 0) at slot floor(k/w), with deadline ceil((k+1)/w); each slot
goes to the released block with the earliest deadline. As the weights fill the slots exactly, every deadline is met, so
after any number of slots each source is less than one block from its target. Weights are exact rationals, so that holds
for the target weights themselves and not for rounded ones.

The driver holds the schedule of at most `slots` slots: where the corpus is larger, blocks are. Every document comes at least
once: a source that would need more slots than that (a weight below 1/`slots`, or one far below its share of bytes)
gets the blocks it lacks behind the last slot, in order of their deadlines; the bound holds for the slots before.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, spare, width


def tempered(totals: dict, power: float = 0.7) -> dict:
    """Target weights from the sources' sizes raised to a power below 1: small sources gain, large ones give."""
    raised = {k: max(v, 1) ** power for k, v in totals.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def whole_parts(weights: dict) -> dict:
    """The weights as whole numbers in the same proportions, exactly."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    least = 1
    for v in exact.values():
        least = least * v.denominator // _gcd(least, v.denominator)
    return {k: int(v * least) for k, v in exact.items()}


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def timetable(weights: dict, need: dict, slots: int) -> tuple[dict, int]:
    """The slots of each source's blocks, by earliest deadline among released blocks, and how many slots were dealt so.

    Slots are dealt until each source has the blocks it needs, but `slots` at most; blocks that are needed still come
    behind, by deadline. Ties go to the source whose name comes first.
    """
    names = sorted(weights, key=str)
    parts = whole_parts(weights)
    total = sum(parts.values())
    out: dict = {k: [] for k in names}
    lacking = {i for i, k in enumerate(names) if need[k] > 0}
    waiting = [(0, i) for i in range(len(names))]  # (release, source); one block of a source at a time
    ready: list[tuple[int, int]] = []
    t = 0
    while lacking and t < slots:
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[names[i]]) + 1) * total // parts[names[i]]), i))
        deadline, i = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        mine = out[names[i]]
        mine.append(t)
        if len(mine) >= need[names[i]]:
            lacking.discard(i)
        heapq.heappush(waiting, (len(mine) * total // parts[names[i]], i))
        t += 1
    late = [(-(-(k + 1) * total // parts[names[i]]), i) for i in lacking for k in range(len(out[names[i]]), need[names[i]])]
    for n, (_, i) in enumerate(sorted(late)):
        out[names[i]].append(t + n)
    return out, t


def _streams(docs: DataFrame, weights: dict | None, block_bytes: int, slots: int, lanes: int, seed: int) -> tuple[DataFrame, list[tuple], int]:
    """doc_id, source, size, start (in the source's stream) and cycle (the stream's bytes an epoch) of every row; the
    schedule as (source, block, slot); and the bytes of a block."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    rows = rows.withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
    found = {r.source: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    plan, table = [], []
    if found:
        weights = weights or tempered({k: r["size"] for k, r in found.items()})
        if missing := [k for k in found if not weights.get(k)]:
            raise ValueError(f"no weight for sources {missing[:5]}")
        if 8 * len(found) > slots:
            raise ValueError("more slots are needed for so many sources")
        weights = {k: weights[k] for k in found}
        all_ = sum(map(Fraction, weights.values()))
        # blocks so large that sources which fill theirs need `slots` slots at most
        block_bytes = max(block_bytes, *(ceil(r["size"] * all_ / Fraction(weights[k]) / slots) for k, r in found.items()))
        when, _ = timetable(weights, {k: -(-r["size"] // block_bytes) for k, r in found.items()}, slots)
        table = [(k, b, t) for k, ts in when.items() for b, t in enumerate(ts)]
        lane_rows = max(4096, -(-sum(r.n for r in found.values()) // lanes))
        plan = [(k, r["size"], len(when[k]) * block_bytes, -(-r.n // lane_rows)) for k, r in found.items()]
    sources = F.broadcast(docs.sparkSession.createDataFrame(plan, "name string, cycle long, served long, lanes int"))
    rows = rows.join(sources, rows.source.eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("lanes")).cast("int"))
    w = Window.partitionBy("source", "lane").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    if any(p[-1] > 1 for p in plan):
        before = offsets(rows, ["source"], "lane", {"size": "sum(size)"}).where("lane > 0").withColumnsRenamed({"source": "name", "lane": "in_lane"})
        at = at.join(before, at.source.eqNullSafe(F.col("name")) & (at.lane == F.col("in_lane")), "left").withColumn("start", F.col("start") + F.coalesce("size_before", F.lit(0))).drop("name", "in_lane", "size_before")
    return at.select("doc_id", "source", "size", "start", "cycle", "served"), table, block_bytes


def _served(at: DataFrame, table: list[tuple], block_bytes: int) -> DataFrame:
    """A row for each time a document is served, with epoch, block (of the whole stream), slot and place (in the block)."""
    slots = F.broadcast(at.sparkSession.createDataFrame(table, "of string, block long, slot long"))  # `slots` rows and the sources' late blocks
    times = at.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(served - 1 - start) div cycle"))))
    times = times.withColumn("_at", F.col("epoch") * F.col("cycle") + F.col("start")).withColumn("block", F.expr(f"_at div {block_bytes}")).withColumn("place", F.expr(f"_at % {block_bytes}"))
    return times.join(slots, times.source.eqNullSafe(F.col("of")) & (times.block == slots.block)).drop(slots.block).drop("of", "_at")


def schedule(docs: DataFrame, weights: dict | None = None, block_bytes: int = 1 << 16, slots: int = 1 << 18, lanes: int = 1 << 14, seed: int = 0) -> DataFrame:
    """A row for each time a document is served: doc_id, source, size, epoch, block, slot, place (its start in the block).

    weights: target weight of each source (the table of sources is what the driver holds); None: `tempered`
    sizes. Slots run until the last source was served whole once, so every document comes at least once; sources
    that end sooner go on with the next epoch, without a gap. block_bytes is the least size of a block (see above). Sources
    are ranked in lanes of about 1/`lanes` of all rows (4096 at least), so that a source with a third of all rows is not
    one group. Sizes are UTF-8 bytes plus 1; a document longer than a block is served where it starts. A null source is a source of its
    own; null and empty texts have size 1; repeated rows are rows of their own; an empty table gives no rows.
    """
    at, table, block_bytes = _streams(docs, weights, block_bytes, slots, lanes, seed)
    return _served(at, table, block_bytes).select("doc_id", "source", "size", "epoch", "block", "slot", "place")


def mixed(docs: DataFrame, weights: dict | None = None, block_bytes: int = 1 << 16, slots: int = 1 << 18, seed: int = 0) -> DataFrame:
    """The documents as often as they are served, columns as they were, in slot order over all parts.

    Rows that share a doc_id come as often as the one that is served first; rows without doc_id come once, at the start.
    """
    at, table, block_bytes = _streams(docs, weights, block_bytes, slots, 1 << 14, seed)
    first = at.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("start", "source", "cycle", "served")).alias("one")).select("doc_id", "one.*")
    name, slot, place = (spare(docs, n) for n in ("_id", "_slot", "_place"))
    times = _served(first, table, block_bytes).select(F.col("doc_id").alias(name), F.col("slot").alias(slot), F.col("place").alias(place))
    out = docs.join(times, docs.doc_id == times[name], "left").drop(name)
    return out.repartitionByRange(width(docs.sparkSession), F.asc_nulls_first(slot), place).sortWithinPartitions(F.asc_nulls_first(slot), place).select(docs.columns)
