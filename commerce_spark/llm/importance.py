"""Importance resampling towards a target: n-gram buckets by suffix arrays over word ids, gains by bucket, a keyed draw.

Per piece of a partition the words get ids, a suffix array of the ids is sorted as deep as the longest n-gram, runs of
suffixes that share n words enumerate the distinct n-grams, each is hashed once, and its bucket goes to all its occurrences.
What the driver holds is two counts a bucket; what is shuffled is counts by bucket and one small row a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH, batch_rows, cut, pieces, text_bytes, trim, width

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:48] = _LOWER[58:65] = _LOWER[91:97] = _LOWER[123:128] = 0  # what stands between words


def word_ids(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the id of every word in order, and the number of each text's words. A-Z are lower-cased;
    a word is a run of ASCII digits and letters and of all other signs above ASCII; null counts as empty."""
    data, at = text_bytes(column)
    low = _LOWER[data]
    inside = low > 0
    edge = np.ones(len(inside) + 1, bool)  # a word may not go on here
    edge[1:-1] = ~inside[:-1]
    edge[at] = True
    begin = np.flatnonzero(inside & edge[:-1])
    stop = np.ones(len(inside) + 1, bool)
    stop[:-1] = ~inside
    stop[at] = True
    end = np.flatnonzero(inside & stop[1:]) + 1
    ends = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    strings = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    coded = strings.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int32), np.diff(np.searchsorted(begin, at))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first `depth` tokens (or more), by doubling; ties by start."""
    rank, known = tokens, 1
    while True:
        order = np.argsort(rank.astype(np.uint16) if rank.max(initial=0) < 1 << 16 else rank, kind="stable")  # short numbers sort by radix
        if known >= depth:
            return order
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - known)] = rank[known:] + 1
        order = order[np.argsort(after[order], kind="stable")]
        order = order[np.argsort(rank[order], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        known *= 2


def occurrences(column: pa.Array, low: int, high: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n from low to high: (bucket of every n-gram, in order of texts and places; number of each text's), and the
    number of each text's words."""
    names, ids, many = word_ids(column)
    # tokens: ids from 1 on, a 0 after each text, which equals nothing
    text = np.repeat(np.arange(len(many)), many)
    tokens = np.zeros(len(ids) + len(many), np.int64)
    at = np.arange(len(ids)) + text
    tokens[at] = ids + 1
    left = np.zeros(len(tokens), np.int64)  # words from here to the text's end
    left[at] = np.repeat(np.cumsum(many), many) - np.arange(len(ids))
    order = suffix_array(tokens, high)
    order = order[left[order] > 0]
    shared = np.zeros(len(order), np.int64)  # words that a suffix shares with the one before, `high` at most
    same = np.ones(len(order), bool)
    same[:1] = False
    for n in range(high):
        here = order + n
        ok = here < len(tokens)
        t = np.where(ok, tokens[np.minimum(here, len(tokens) - 1)], 0)
        same[1:] &= (t[1:] == t[:-1]) & (t[1:] > 0)
        shared += same
    out = []
    for n in range(low, high + 1):
        whole = left[order] >= n
        run = np.cumsum(shared < n)[whole]  # the number of each suffix's run
        starts = order[whole]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        heads = (tokens[starts[first][:, None] + np.arange(n)] - 1).tolist()
        grams = [names[t] for (t,) in heads] if n == 1 else [b" ".join([names[t] for t in g]) for g in heads]
        hashed = np.fromiter(map(zlib.crc32, grams), np.int64, len(first)) % buckets
        bucket = np.full(len(tokens), -1, np.int64)
        bucket[starts] = np.repeat(hashed, np.diff(np.append(first, len(starts))))
        bucket = bucket[at]
        out.append((bucket[bucket >= 0], np.maximum(many - (n - 1), 0)))
    return out, many


def counts(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The number of n-grams in each bucket, over all texts: one row a bucket and task meets in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, "text", rows=4096, mb=8):
            for bucket, _ in occurrences(b.column(0), low, high, buckets)[0]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    with batch_rows(docs.sparkSession, BATCH):
        for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of want's share over have's share of each bucket, one added to every count, floored."""
    b, s, t = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((float(x) + 1) * (s + b) / ((float(y) + 1) * (t + b)))) for x, y in zip(want.tolist(), have.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the sum of its n-grams' gains."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", rows=4096, mb=8):
            found, many = occurrences(b.column(1), low, high, len(gain))
            total, features = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
            for bucket, each in found:
                ends = np.concatenate(([0], np.cumsum(gain[bucket])))[np.concatenate(([0], np.cumsum(each)))]
                total += np.diff(ends)
                features += each
            yield pa.record_batch([b.column(0), pa.array(many.astype(np.int64)), pa.array(features), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Floored thousandths of a Gumbel draw keyed by seed and doc_id; a null id draws as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank counts the drawn ones from 1, null elsewhere.

    Of the rows with `least_words` words or more the floor of `percent` in a hundred are drawn: the highest scores, ties to
    the smaller doc_id (null first), then as they come. The draw sorts small rows by range; no task ranks them all. Null and
    empty texts have no features and weight 0; n-grams never cross texts; repeated rows are rows of their own; an empty table
    gives no rows, an empty target a gain for every bucket. A piece takes some 20 times its text's bytes, 8 MB or one text.
    """
    gain = gains(counts(docs, low, high, buckets), counts(target, low, high, buckets))
    scored = cut(weights(docs, gain, low, high).withColumn("score", F.col("weight") + noise(seed)))
    may = F.col("n_words") >= least_words
    drawn = scored.where(may).count() * percent // 100
    key = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_at")]  # _at: the row's place in the checkpoint, which stays
    ranged = scored.where(may).withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(width(docs.sparkSession), *key).sortWithinPartitions(*key)
    placed = cut(ranged).withColumn("_row", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_row", 33), "_in": F.col("_row").bitwiseAND((1 << 33) - 1)})
    before, sizes = 0, []
    for r in sorted(placed.groupBy("_part").count().collect()):  # a row a partition
        sizes.append((r._part, before))
        before += r["count"]
    table = F.broadcast(docs.sparkSession.createDataFrame(sizes, "_part long, _before long"))
    rank = F.col("_before") + F.col("_in") + 1
    out = placed.join(table, "_part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return out.select(*columns).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def sql(buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> str:
    """DuckDB SQL of `resample` with single words over the views documents and benchmark; CRC-32 bit by bit."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    found = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ws FROM documents),
have AS (SELECT r, unnest(ws) AS w FROM docs), want AS (SELECT unnest({found}) AS w FROM benchmark),
named AS (SELECT w, xor({crc}, 4294967295) % {buckets} AS bucket FROM (SELECT w FROM have UNION SELECT w FROM want)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM have JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM want JOIN named USING (w) GROUP BY bucket),
whole AS (SELECT (SELECT count(*) FROM have)::DOUBLE AS s_all, (SELECT count(*) FROM want)::DOUBLE AS t_all),
gained AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {buckets}) / ((s + 1) * (t_all + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), whole),
summed AS (SELECT r, sum(gain)::BIGINT AS weight FROM have JOIN named USING (w) JOIN gained USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN summed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, n_words AS n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= (SELECT count(*) FROM scored WHERE n_words >= {least_words}) * {percent} // 100 THEN place END AS rank FROM ranked"""
