from __future__ import annotations

import duckdb

import corpus_pipeline
from commerce_spark.llm import simhash
from tests.llm.test_simhash import brute_similar
from tests.llm.test_text import brute_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], data).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, known, near, cut, mixed, out = seen
    assert all(df.columns == COLUMNS for df in seen[:-1])
    texts = {r.doc_id: r.text for r in raw.collect()}
    assert {r.doc_id for r in known.collect()} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    parts = brute_similar({r.doc_id: r.text for r in known.collect()})[0]
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(parts.values()))
    left = {r.doc_id: r.text for r in near.collect()}
    lost = brute_digest(left, 200)
    after = {r.doc_id: r.text for r in cut.collect()}
    assert all(after[i] == t for i, t in left.items() if not lost[i][1])
    assert set(left) - set(after) <= {i for i in left if lost[i][1] and lost[i][0] - lost[i][1] < 64}
    assert {r.doc_id for r in mixed.collect()} == set(after)
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(after) and all(r.lossless for r in rows) and len(rows) == mixed.count()


def test_run_and_odd_rows(spark, odd, tmp_path):
    odd.select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {9, 10, None} <= got and not got & {1, 2, 3, 7, 8}  # 7 says one passage over and over: every string of it starts twice
    odd.select(COLUMNS).where("false").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_exact_copies_leave_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    groups = duckdb.sql(f"select list(doc_id) from '{data}/documents.parquet' group by text having count(*) > 1").fetchall()
    assert all(len(kept & set(g)) <= 1 for (g,) in groups)
