"""License scans, vector codes and importance resampling against brute force and against their SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commerce_spark.llm import codes, importance, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("name", ["op11_licenses", "op12_codes", "op13_importance"])
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    told = con.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, data).select(*told.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, told.fetchall()))


# --- licenses ------------------------------------------------------------------------------------------------


def base(text):
    """Plain loops: (number of words, places, first, last, labels)."""
    w = words(text)
    found = [(i, t.label) for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def scanned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan(df, **options).collect(), key=lambda r: r.doc_id)]


def test_base_places_equal_plain_loops(spark, data, texts):
    got = {r.doc_id: r for r in queries.op11_licenses(spark, data).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: base(t) for i, t in texts.items()}
    assert all(r.score == 1 for r in got.values() if r.n_base) and any(r.n_base for r in got.values())


def test_whole_licenses_with_edits(spark):
    mit = licenses.NOTICES[0].words
    w = mit.split()
    put_in = " ".join([*w[:9], "whoever", "that", "may", "be", *w[9:]])
    left_out = " ".join(w[:20] + w[23:])
    changed = " ".join(x if i % 15 else "other" for i, x in enumerate(w))
    prose = " ".join(f"w{i}" for i in range(300))
    texts = [mit, f"{prose} {put_in.upper()} {prose}", left_out.replace(" ", "\n--"), changed, " ".join(w[:20]), " ".join(sorted(w)), f"{mit} {prose} {mit} {mit}", "the MIT-License, MIT license. Apache\tLICENSE", "É mit licensé GENERAL public license"]
    got = scanned(spark, texts)
    assert [r.labels for r in got] == ["mit", "mit", "mit", "mit", "", "", "mit", "apache,mit", "gpl"]
    assert got[0].score == 1 and all(0.75 <= r.score < 1 for r in got[1:4]) and got[4].score == got[5].score == 0
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[7:]] == [(3, 1, 5, "apache,mit"), (1, 3, 3, "gpl")]
    df = spark.createDataFrame([(0, texts[6])], "doc_id long, text string")
    spans = sorted((r.first_word, r.last_word, r.coverage) for r in licenses.spans(df).collect())
    assert spans == [(0, len(w) - 1, 1.0), (len(w) + 300, 2 * len(w) + 299, 1.0), (2 * len(w) + 300, 3 * len(w) + 299, 1.0)]


def test_longer_grams_and_other_templates(spark):
    mine = (licenses.Template("x", "a b c d"), licenses.Template("y", "c d e", base=True))
    got = scanned(spark, ["a b c d e", "a b x d", "c d e c d e"], templates=mine, k=3)
    assert [(r.labels, r.n_base) for r in got] == [("x,y", 1), ("", 0), ("y", 2)]
    with pytest.raises(ValueError, match="needs 3 words"):
        licenses.positions(spark, licenses.BASE, 3)


def test_odd_texts_scan(spark, odd, none):
    clash = odd.withColumns({c: F.lit("mit license") for c in ("a", "b", "t", "words", "label", "score", "n_words")})
    rows = sorted(licenses.scan(clash).collect(), key=repr)
    want = sorted([(r.doc_id, *base(r.text)) for r in odd.collect()], key=repr)
    assert sorted([tuple(r)[:6] for r in rows], key=repr) == want
    assert licenses.scan(none).count() == 0
    hot = spark.createDataFrame([(i % 3 or 7, "under the mit license" if i % 3 else None) for i in range(300)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_base, r.score) for r in licenses.scan(hot).collect()) == {(7, 0, 0.0): 100, (1, 1, 1.0): 100, (2, 1, 1.0): 100}


def test_scan_runs_in_the_jvm(spark, data):
    plan = queries.op11_licenses(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


# --- codes ---------------------------------------------------------------------------------------------------


def plain_nearest(x, entries):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, label, integers). The contract by plain loops."""
    w = len(rows[0][2]) // parts
    of = lambda v, p: v[p * w : p * w + w]
    first = {}
    for i, _, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, v)
    books = [[of(v, p) for v in list(first.values())[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        found = [plain_nearest([of(v, p) for _, _, v in rows], books[p]) for p in range(parts)]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [of(rows[i][2], p) for i, x in enumerate(found[p][0]) if x == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(found[p][1][i] for p in range(parts)) for i in range(len(rows))]
    by = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{found[p][0][k]:02x}" for p in range(parts)), errors[k], by[label], sha)) for k, (i, label, _) in enumerate(rows))


def test_codes_equal_plain_loops(spark, data):
    rows = duckdb.sql(f"select vec_id, label, embedding from '{data}/embeddings.parquet' order by vec_id").fetchall()
    rows = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op12_codes(spark, data).collect()]
    assert sorted(map(repr, got)) == plain_codes(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 20), st.integers(1, 40), st.sampled_from([1, 3, 200, 1 << 20, 1 << 28]), st.integers(0, 1 << 30))
def test_bounds_lose_nothing(w, m, n, most, seed):
    rng = np.random.default_rng(seed)
    x, entries = (rng.integers(-most, most + 1, (k, w)) for k in (n, m))
    x[: n // 2] = x[0]  # copies, constant rows and ties
    entries[m // 2 :, 1:] = entries[m // 2 :, :1]
    index, dist = codes.nearest(x, entries)
    assert (index.tolist(), dist.tolist()) == plain_nearest(x, entries)


def test_bounds_spare_distances():
    """Of 64 entries, 20 are measured exactly for random directions of four components: the worst case for means."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((4000, 4)) * 40).astype(np.int64)
    seen: list[int] = []
    codes.nearest(x, x[:64], seen)
    print("exact distances a vector, of 64", sum(seen) / len(x))
    assert sum(seen) < 24 * len(x)
    smooth = np.repeat(x[:, :1], 4, axis=1) + rng.integers(-3, 4, x.shape)
    seen.clear()
    codes.nearest(smooth, smooth[:64], seen)
    print("of smooth parts", sum(seen) / len(x))
    assert sum(seen) < 12 * len(x)


def test_odd_vectors_get_codes(spark):
    v = [float(x) for x in range(16)]
    rows = [(0, v, "a"), (1, v[::-1], None), (1, v[::-1], None), (2, None, "a"), (3, [], "a"), (4, [None, *v[1:]], "a"), (5, [math.nan, *v[1:]], "a"), (6, [math.inf, *v[1:]], "a"), (7, [1.0, 2.0], "a"), (None, [-0.001] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"code": F.lit(1), "error": F.lit(2), "_label": F.lit(3)})
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, entries=3).collect()]
    kept = [(0, "a", v), (1, None, v[::-1]), (1, None, v[::-1]), (None, None, [-0.001] * 16)]
    assert sorted(map(repr, got)) == plain_codes([(i, k, [math.floor(256 * c) for c in x]) for i, k, x in kept], entries=3)
    none = codes.compress(df.where("false"))
    assert none.count() == 0 and "codebooks_sha256" in none.columns
    with pytest.raises(ValueError, match="equal parts"):
        codes.fit(df.where("vec_id = 7"))
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(df.where("vec_id = 0").withColumn("embedding", F.array_repeat(F.lit(1e30), 16))).collect()


def test_many_labels_go_by_lanes(spark, monkeypatch):
    rows = [(i, [float(i % 7)] * 16, i % 5 or None) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(repr, codes.compress(df, entries=4).collect()))
    monkeypatch.setattr(codes, "LABELS", 1)
    assert sorted(map(repr, codes.compress(df, entries=4).collect())) == want


# --- importance ----------------------------------------------------------------------------------------------


def plain_draw(docs, target, low=1, high=1, buckets=10_000, seed=2024, least=20, percent=10):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(features(t))
    for t in target:
        want.update(features(t))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets))))
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


def test_draw_equals_plain_loops(spark, data, texts):
    target = [r[0] for r in duckdb.sql(f"select text from '{data}/benchmark.parquet'").fetchall()]
    df = spark.read.parquet(f"{data}/documents.parquet")
    aim = spark.read.parquet(f"{data}/benchmark.parquet")
    for options in ({}, {"low": 1, "high": 2, "buckets": 997, "seed": 5, "percent": 37}, {"low": 2, "high": 3, "least_words": 1, "percent": 100}):
        got = importance.resample(df, aim, **{"least_words" if k == "least" else k: v for k, v in options.items()})
        told = {("least" if k == "least_words" else k): v for k, v in options.items()}
        assert sorted(map(repr, map(tuple, got.collect()))) == plain_draw(list(texts.items()), target, **told)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "Z"]), max_size=12), max_size=6), st.integers(1, 4))
def test_runs_equal_counted_grams(texts, high):
    texts = [" ".join(t) if t else None for t in texts]
    found, many = importance.occurrences(pa.array(texts, pa.string()), 1, high, 1 << 20)
    split = [words(t) for t in texts]
    assert many.tolist() == [len(w) for w in split]
    for n, (bucket, each) in enumerate(found, 1):
        assert each.tolist() == [max(0, len(w) - n + 1) for w in split]
        assert bucket.tolist() == [zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 20) for w in split for i in range(len(w) - n + 1)]


def test_suffixes_are_sorted_to_the_depth():
    t = np.random.default_rng(0).integers(0, 3, 400)
    for depth in (1, 2, 3, 5, 8):
        order = importance.suffix_array(t, depth)
        keys = [t[i : i + depth].tolist() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(400))


def test_odd_texts_draw(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    clash = odd.withColumns({c: F.lit(0) for c in ("rank", "score", "weight", "_at", "_part", "_row")})
    for target, aim in (([t for _, t in docs], odd), ([], none)):
        got = importance.resample(clash, aim, least_words=1, percent=50)
        assert sorted(map(repr, map(tuple, got.collect()))) == plain_draw(docs, target, least=1, percent=50)
    assert importance.resample(none, odd).count() == 0
    ties = spark.createDataFrame([(5, "same words here")] * 40, "doc_id long, text string")
    got = importance.resample(ties, odd, least_words=1, percent=25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 40
