from __future__ import annotations

import zlib

import duckdb

from commerce_spark.llm import langid, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall())
    rows = queries.op3_langid(spark, folder).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    print("held-out accuracy", right / len(held))
    assert right >= 0.97 * len(held)


def test_odd_rows(spark, odd, none, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8)) and got[9].lang_pred != "und"
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 9, 10, None}
    assert all(r.lang for r in kept.collect())
    assert langid.predict(none, model).count() == 0
    blank = langid.fit(none)
    assert [r.lang_pred for r in langid.predict(odd, blank).distinct().collect()][0] == "und"
    single = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs, single).collect()} <= {"en", "und"}


def test_labels_of_test_rows_have_no_say(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(~langid.held_out())
    a, b = langid.fit(docs, per_language=20), langid.fit(docs, per_language=20)
    assert (a.weights == b.weights).all() and a.pairs == b.pairs
    assert a.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}


def test_long_texts_without_a_letter_have_no_language(spark, data):
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"), per_language=20)
    signs = ["\u2014" * 22, "\u2026 " * 40, "\U0001f600" * 16, "\u0664\u0662 " * 32, "\u2500\u2502\u253c" * 50, "12 34 " * 100]
    assert model.predict(signs)[0] == ["und"] * len(signs) and not model.predict(signs)[1].any()
    assert model.predict([s + " und dann" for s in signs])[0] != ["und"] * len(signs)
    docs = spark.createDataFrame([(i, s, None, "a", len(s)) for i, s in enumerate([*signs, "some plain words"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in langid.keep_known(docs, model).collect()] == [len(signs)]
