"""License scans by diagonal voting: word k-grams of documents joined to those of templates, votes by offset.

A k-gram of a document at word `pos` that equals a template's k-gram at `tpos` votes for the diagonal `pos - tpos`, the
word where the template would start. Diagonals with enough votes that lie near each other (words put in or left out) are
merged, and a merged span holds if the k-grams found in order cover enough of the template and lie close enough together.

Only built-in functions run. The templates are broadcast behind a check of their size; what is shuffled is hits, by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, once A-Z are lower-cased
BROADCAST = 1 << 16  # k-grams of templates that are broadcast at most (some 10 MB); more are joined by shuffle


@dataclass(frozen=True)
class Template:
    """Words to look for. base: a phrase that must stand as it is. need: the least share of its k-grams."""

    label: str
    words: str
    base: bool = False
    need: float = 0.75

    @property
    def least(self) -> float:
        return 1.0 if self.base else self.need


# The phrases of the contract, then the wording of licenses and of their usual notices, word by word.
BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("gpl", "licensed under the gnu general public license version"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc", "this work is licensed under a creative commons attribution", need=0.85),
    Template("cc", "licensed under cc by", need=1.0),
)
TEMPLATES = BASE + NOTICES


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: whatever stands between ASCII signs other than digits and letters."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, APART), "")


def grams(k: int) -> Column:
    """All runs of k consecutive words of the column `words`, as an array of structs w0, w1, ..."""
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    return F.arrays_zip(*[F.slice("words", i + 1, n).alias(f"w{i}") for i in range(k)])


def _gram_hash(k: int) -> Column:
    return F.xxhash64(*[F.col(f"w{i}") for i in range(k)])


def _fields(k: int, prefix: str = "") -> list[Column]:
    return [F.col(f"gram.w{i}").alias(f"{prefix}w{i}") for i in range(k)]


def positions(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """Every k-gram of every template: t, tpos, n_grams, label, base, least, t_h and its words t_w0, ..."""
    short = [t.words for t in templates if len(t.words.split()) < k]
    if short:
        raise ValueError(f"a template needs {k} words: {short[0]!r}")
    rows = [(i, t.label, t.base, t.least, t.words.split()) for i, t in enumerate(templates)]
    df = spark.createDataFrame(rows, "t int, label string, base boolean, least double, words array<string>")
    df = df.select("t", "label", "base", "least", (F.size("words") - (k - 1)).alias("n_grams"), F.posexplode(grams(k)).alias("tpos", "gram"))
    df = df.select("t", "label", "base", "least", "n_grams", "tpos", *_fields(k))
    return df.withColumn("t_h", _gram_hash(k)).withColumnsRenamed({f"w{i}": f"t_w{i}" for i in range(k)})


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, a name of 128 bits for each row (rows that repeat have the same), and the words."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b"), words(F.col("text")).alias("words"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = 2) -> DataFrame:
    """Verified spans: a, b, doc_id, t, label, base, first_word, last_word, coverage (share of the template's k-grams).

    Per document and template, diagonals of three votes (or all k-grams of a shorter template) or more are merged while the
    next one lies within an eighth of the template's length; base phrases are never merged. Repeated rows give one set of spans.
    """
    table = positions(docs.sparkSession, templates, k)
    if table.count() <= BROADCAST:
        table = F.broadcast(table)
    rolled = _named(docs).select("a", "b", "doc_id", F.posexplode(grams(k)).alias("pos", "gram")).select("a", "b", "doc_id", "pos", *_fields(k)).withColumn("h", _gram_hash(k))
    same = F.col("h") == F.col("t_h")
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t_w{i}"))
    hits = rolled.join(table, same).select("a", "b", "doc_id", "t", "label", "base", "least", "n_grams", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    hits = hits.repartition("a", "b").dropDuplicates(["a", "b", "t", "tpos", "pos"])  # what follows needs no other shuffle
    of = ["a", "b", "t"]
    hits = hits.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*of, "diagonal"))).where(F.col("votes") >= F.least(F.lit(3), "n_grams"))
    order = Window.partitionBy(*of).orderBy("diagonal", "tpos")
    slack = F.when(F.col("base"), 0).otherwise(F.floor((F.col("n_grams") + (k - 1)) / 8))
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    hits = hits.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    covered = hits.groupBy(*of, "span", "doc_id", "label", "base", "least", "n_grams", "tpos").agg(F.min("pos").alias("first_word"), F.max("pos").alias("last_gram"))
    merged = covered.groupBy(*of, "span", "doc_id", "label", "base", "least", "n_grams").agg(F.min("first_word").alias("first_word"), F.max("last_gram").alias("last_gram"), F.count(F.lit(1)).alias("n"))
    merged = merged.withColumn("coverage", F.col("n").cast("double") / F.col("n_grams").cast("double"))
    close = (F.col("last_gram") - F.col("first_word") + 1) * F.col("least") <= F.col("n_grams")
    found = merged.where((F.col("coverage") >= F.col("least")) & close)
    return found.select(*of, "doc_id", "label", "base", "first_word", (F.col("last_gram") + (k - 1)).alias("last_word"), "coverage")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = 2) -> DataFrame:
    """One row a document: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start), base_labels, labels, score (the best coverage of a verified span, 0 without one).

    Null texts count as empty; empty texts and texts shorter than k words have no spans. Repeated rows each get the same
    result; rows may share an id, or have none. An empty table gives no rows. Other columns of docs are not looked at.
    """
    label = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    start = F.when(F.col("base"), F.col("first_word"))
    per = spans(docs, templates, k).groupBy("a", "b").agg(
        F.count_if("base").alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"),
        label(F.when(F.col("base"), F.col("label"))).alias("base_labels"), label(F.col("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    rows = _named(docs).select("doc_id", "a", "b", F.size("words").cast("long").alias("n_words"))
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    found = rows.join(per, ["a", "b"], "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL of `scan` for k = 2 over the view documents, by words instead of hashes."""
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.least}::DOUBLE, '{t.words}')" for i, t in enumerate(templates))
    return f"""
WITH templates AS (SELECT t, label, base, least, string_split(words, ' ') AS w FROM (VALUES {rows}) v(t, label, base, least, words)),
grams AS (SELECT t, label, base, least, len(w) - 1 AS n_grams, i AS tpos, w[i + 1] AS w0, w[i + 2] AS w1 FROM templates, unnest(range(len(w) - 1)) u(i)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
rolled AS (SELECT r, i AS pos, w[i + 1] AS w0, w[i + 2] AS w1 FROM docs, unnest(range(len(w) - 1)) u(i)),
hits AS (SELECT r, t, label, base, least, n_grams, tpos, pos, pos - tpos AS diagonal FROM rolled JOIN grams USING (w0, w1)),
voted AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, t, diagonal) AS votes FROM hits) WHERE votes >= least(3, n_grams)),
begun AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal, tpos) > CASE WHEN base THEN 0 ELSE (n_grams + 1) // 8 END, true) AS begins FROM voted),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY r, t ORDER BY diagonal, tpos ROWS UNBOUNDED PRECEDING) AS span FROM begun),
merged AS (SELECT r, t, span, label, base, least, n_grams, min(pos) AS first_word, max(pos) AS last_gram, count(DISTINCT tpos)::DOUBLE / n_grams AS coverage FROM numbered GROUP BY r, t, span, label, base, least, n_grams),
found AS (SELECT * FROM merged WHERE coverage >= least AND (last_gram - first_word + 1) * least <= n_grams),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN per USING (r)"""
