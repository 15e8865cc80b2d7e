from __future__ import annotations

import duckdb
import numpy as np
import pytest

from commerce_spark.llm import queries, rpforest, topk
from commerce_spark.llm.common import local_components


@pytest.fixture(scope="module")
def vectors(data):
    rows = duckdb.sql(f"select vec_id, embedding from '{data}/embeddings.parquet' order by vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)


def brute_top(ids, x, queries_, k):
    q = np.floor(256 * x).astype(np.int64)
    out = set()
    for i in queries_:
        scores = q @ q[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out |= {(int(i), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    return out


def test_top_k_equals_brute_force(spark, data, vectors):
    ids, x = vectors
    assert {tuple(r) for r in queries.op5_topk(spark, data).collect()} == brute_top(ids, x, ids[ids % 50 == 0], 5)


def test_top_k_with_ties_copies_and_norms(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((400, 6)) * rng.choice([0.1, 1, 5], (400, 1)), 1)
    x[100:250] = x[3]
    ids = np.arange(400)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=7, pivots=4, rings=3, block_rows=16)
    assert {tuple(r) for r in got.collect()} == brute_top(ids, x, ids[ids % 50 == 0], 7)


ODD = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), scale=1.0).collect()}
    assert got == {(0, 1, 8, 2), (0, 2, 50, 1), (0, 3, 7, 0), (50, 1, 8, 2), (50, 2, 0, 1), (50, 3, 7, 0)}
    rows = {r.vec_id: tuple(r)[1:] for r in rpforest.classes(df).collect()}
    assert rows[0] == (2, 0, True) and rows[50] == (2, 0, False) and rows[8] == (2, 0, False)
    assert all(rows[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 9)) and None not in rows
    none = df.where("false")
    assert topk.top_k(none, none).count() == 0 and rpforest.classes(none).count() == 0


def test_forest_finds_the_links(spark, data, vectors):
    ids, x = vectors
    n = np.sqrt((x * x).sum(axis=1))
    c = x @ x.T / np.outer(n, n)
    np.fill_diagonal(c, 0)
    links = c >= 0.95
    got = {r.vec_id: r for r in queries.op8_rpforest(spark, data).collect()}
    found, all_ = sum(r.n_links for r in got.values()), int(links.sum())
    print("recall of links", found / max(1, all_))
    assert 0.9 * all_ <= found <= all_
    label = local_components(len(ids), *np.nonzero(links))
    if found == all_:
        assert all(got[int(i)].component_id == ids[label[k]] for k, i in enumerate(ids))
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_forest_with_blocks_and_large_groups(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + rng.standard_normal((260, 16)) * 0.02, rng.standard_normal((200, 16)), np.tile(centre, (40, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.sqrt((x * x).sum(axis=1))
    c = x @ x.T / np.outer(n, n)
    np.fill_diagonal(c, 0)
    got = {r.vec_id: r.n_links for r in rpforest.classes(df, trees=4, leaf=32, block_rows=24).collect()}
    assert [got[i] for i in range(500)] == (c >= 0.95).sum(axis=1).tolist()


def planted(n, pairs, low, high, seed=0, width=64):
    """Random directions; the first pairs of rows have cosines from low to high."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        c, v = rng.uniform(low, high) + 1e-6, rng.standard_normal(width)
        v -= v @ x[2 * k] * x[2 * k]
        x[2 * k + 1] = c * x[2 * k] + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    return x


def work(n, pairs=500):
    """Recall of planted pairs and comparisons a row, with the operator's parameters."""
    import inspect

    p = {k: v.default for k, v in inspect.signature(rpforest.classes).parameters.items()}
    x = planted(n, pairs, 0.95, 0.97)
    sample = x[np.random.default_rng(1).permutation(n)[: p["sample_rows"]]]
    forest = rpforest.Forest(sample, p["trees"], max(8, p["leaf"] * len(sample) // n), 0.95, p["spill"])
    row, leaf = forest.leaves(x)
    own = np.split(leaf, np.searchsorted(row, np.arange(1, n)))
    sizes = np.unique(leaf, return_counts=True)[1].astype(float)
    return sum(bool(np.intersect1d(own[2 * k], own[2 * k + 1]).size) for k in range(pairs)) / pairs, (sizes * (sizes - 1) / 2).sum() / n


def test_forest_recall_and_cost_at_size():
    """Pairs at cosines of 0.95 to 0.97 among 60,000 vectors; comparisons grow by less than a power of 1.3."""
    (small, cost), (large, more) = work(6_000), work(60_000)
    print("recall", small, large, "comparisons a row", cost, more)
    assert min(small, large) >= 0.98 and more < cost * 10**0.3


def test_forest_links_planted_pairs(spark):
    x = planted(3000, 200, 0.95, 0.96, seed=4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in rpforest.classes(df).where("n_links > 0").collect()}
    c = x @ x.T
    np.fill_diagonal(c, 0)
    want = np.argwhere(np.triu(c >= 0.95))
    assert len(want) == 200 and sum(got.get(i) == got.get(j, -1) for i, j in want) >= 0.98 * len(want)


def test_bounds_prune_where_vectors_have_clusters(spark):
    """Bounds rule out nearly nothing of random directions, and most of well-parted clusters."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((24, 8)) * 8
    x = np.concatenate([c + rng.standard_normal((60, 8)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = topk.Index(topk.parse(df))
    q = topk.quantise(x[::50])
    floors = np.sort(q @ topk.quantise(x).T, axis=1)[:, -6]
    share = index.pruned(q, floors)
    print("pruned", share)
    assert share > 0.5
