"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells. A row's cell comes from the hash of its text, so equal texts share a cell; virtual nodes of
the shards sit on distinct cells. Rows go to the first virtual node clockwise whose shard is not full, in ring order.
What the driver holds is one count for each cell: bounded by the ring, whatever the input.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring(shards: int, vnodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, by cell. A node's place depends on its shard and number alone, but
    for a cell already taken by an earlier shard, from where it moves one cell on."""
    if shards * vnodes > CELLS // 2:
        raise ValueError("too many virtual nodes for the ring")
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            c = xxhash.xxh64_intdigest(f"{s}/{v}", seed) >> (64 - CELL_BITS)
            while c in at:
                c = (c + 1) % CELLS
            at[c] = s
    return sorted(at.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: with slack 0 they add up to `rows` and differ by one at most."""
    if slack:
        return [-(-rows * round((1 + slack) * 1_000_000) // (shards * 1_000_000))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: dict[int, int], shards: int, vnodes: int, slack: float = 0.0, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first, end, shard, slot of the first) of the cells' rows, cells in ring order."""
    nodes = ring(shards, vnodes, seed)
    left = capacities(sum(counts.values()), shards, slack)
    slot = [0] * shards
    skip = list(range(1, len(nodes))) + [0]  # the next node to try; paths over full shards are shortened

    def open_(k: int) -> int:
        path = []
        while left[nodes[k][1]] == 0:
            path.append(k)
            k = skip[k]
        for p in path:
            skip[p] = k
        return k

    out, k = [], 0
    for cell in sorted(counts):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        at, first, n = k % len(nodes), 0, counts[cell]
        while first < n:
            at = open_(at)
            s = nodes[at][1]
            take = min(n - first, left[s])
            out.append((cell, first, first + take, s, slot[s]))
            slot[s] += take
            left[s] -= take
            first += take
    return out


def place(docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.0, lanes: int = 1 << 14, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Rows of a cell keep the order (hash of the text, doc_id), so equal texts stay together until a shard is full.
    A cell with over 1/`lanes` of all rows (4096 at least) is ranked in lanes dealt by doc_id, so that a text with a
    third of all rows is not one group; there are fewer extra lanes than `lanes`. A null text counts as no bytes (size 1, crc32 0); repeated rows get slots of their own; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text, F.lit(seed)), 0).alias("pos"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("pos", 64 - CELL_BITS).cast("int"))
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    lane_rows = max(4096, -(-sum(counts.values()) // lanes))
    hot = [(c, -(-n // lane_rows)) for c, n in counts.items() if n > lane_rows]
    rows = rows.join(F.broadcast(spark.createDataFrame(hot, "cell int, lanes int")), "cell", "left")
    rows = rows.withColumn("lane", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("lanes")).cast("int"), F.lit(0))).drop("lanes")
    w = Window.partitionBy("cell", "lane").orderBy("pos", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    if hot:
        before = offsets(rows, ["cell"], "lane", {"n": "count(1)"}).where("lane > 0")
        ranked = ranked.join(F.broadcast(before), ["cell", "lane"], "left").withColumn("rank", F.col("rank") + F.coalesce("n_before", F.lit(0)))
    table = spark.createDataFrame(fill(counts, shards, vnodes, slack, seed), "cell int, first long, until long, shard int, base long")
    found = ranked.join(F.broadcast(table), "cell").where("rank >= first and rank < until")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
