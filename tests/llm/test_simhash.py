from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from commerce_spark.llm import common, queries, simhash


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, data, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, data).collect()}
    fps = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    parts = brute_components(fps, 2)
    assert got == {i: (f"{fps[i]:016x}", parts[i]) for i in texts}


@pytest.mark.parametrize(("bits", "segments", "bucket"), [(2, None, 4096), (2, 4, 16), (6, None, 64), (9, None, 4096)])
def test_links_connect_what_brute_force_connects(spark, bits, segments, bucket):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for s in seeds:
        for _ in range(25):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(0, bits + 2)):
                x ^= 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    named = {r.node % (1 << 64): r.component for r in common.components(simhash.links(df, bits, segments, bucket)).collect()}
    want = brute_components({x: x for x in fps}, bits)
    mine: dict = {}
    for x in fps:
        mine.setdefault(named.get(x, x), set()).add(x)
    theirs: dict = {}
    for x, c in want.items():
        theirs.setdefault(c, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def plain_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_similar(texts):
    """Classes by the exact similarity of all pairs, and the pairs with it."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids, root, found = sorted(sets), {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
                if a != b:
                    found.append((i, j, len(a & b) / len(a | b)))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}, found


def test_similar_classes_of_the_table(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    assert got == brute_similar(texts)[0]


def test_similar_classes_of_edited_texts(spark):
    """Copies with edits around the bound, all with one common passage: no false link, and nearly all true ones."""
    rng = np.random.default_rng(8)
    texts = {}
    for s in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 300)))]
        for _ in range(5):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[at] = f"e{rng.integers(0, 1 << 30)}"
            texts[len(texts)] = " ".join(copy) + " these words are said in every one of the texts"
    texts |= {500: None, 501: "", 502: " \n", 503: "one", 504: "One"}
    want, pairs = brute_similar(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    caught = [got[i] == got[j] for i, j, _ in pairs]
    print("pairs of 0.8 or more in one class", len(caught), sum(caught) / len(caught))
    assert len(caught) > 100 and sum(caught) >= 0.97 * len(caught)


def test_large_buckets_are_cut_into_blocks(spark):
    """One large group of near copies: blocks of few rows join it as one task does, by few pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 9000, 200)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[int(rng.integers(0, 200))] = f"e{i}"
        texts.append((i, " ".join(copy)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(i, simhash._wide(simhash.shingle_hashes(t, 5))) for i, t in texts]
    nodes = spark.createDataFrame(rows, "node long, fp binary")
    for bucket in (2048, 16):
        pairs = [(r.a, r.b) for r in simhash.near(nodes, 0.8, bucket).collect()]
        assert set(brute_joined(150, pairs).values()) == {0} and len(pairs) < 150 * 40
    assert {r.component_id for r in simhash.similar_classes(docs).collect()} == {0}


def brute_joined(n, pairs):
    label = common.local_components(n, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    return dict(enumerate(label.tolist()))


def test_spanning_forest_keeps_every_radius():
    rng = np.random.default_rng(2)
    left, right, weight = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    keep = simhash._spanning(60, left, right, weight)
    assert len(keep) < 60
    for w in range(9):
        every = common.local_components(60, left[weight <= w], right[weight <= w])
        few = keep[weight[keep] <= w]
        assert (every == common.local_components(60, left[few], right[few])).all()


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.component_id) for r in simhash.classes(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9)} <= got and simhash.classes(odd).count() == odd.count()
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for _, i in ids].count(9) == 1 and (False, 5) not in ids and (True, 0) in ids
    assert simhash.classes(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
