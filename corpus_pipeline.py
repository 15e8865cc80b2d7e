"""A training corpus from raw documents: five stages, each an operator of commerce_spark.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from commerce_spark.llm import langid, mixing, sentencepiece_bpe, simhash, suffixdedup
from commerce_spark.llm.common import shared_dir


ROWS = 2000  # rows of an Arrow batch: the JVM and a Python worker hold the whole texts of one at a time


def _small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have at most ROWS rows (or fewer, where fewer are set): a stage is
    written after its function has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go, and a missing lang is filled in."""
    _small_batches(spark)
    model = langid.fit(docs)
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    _small_batches(spark)
    return simhash.keep_first(docs, words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 or more that start at two places."""
    _small_batches(spark)
    return suffixdedup.strip(docs, length=200)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document comes at least once, those of small sources again in later epochs."""
    _small_batches(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, segmented with seeded merge-dropout."""
    _small_batches(spark)
    return sentencepiece_bpe.encode(docs, tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=17)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: The stages hash, sort suffixes and merge pieces: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each stage returns is kept in the shared folder."""
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
