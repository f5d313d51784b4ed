"""From raw documents to token files: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all
rows that its predecessor kept. The last returns what reading its token files gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilewatch.llm import decontam, langid, minhash, mixing, token_ids
from profilewatch.llm.queries import vocabulary_path
from profilewatch.llm.tables import table
from profilewatch.session import configure, scratch_path

#: Probability below which a prediction counts as no language.
MIN_SCORE = 0.5
SHINGLE = 5
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, texts without letters and doubtful ones go."""
    model = langid.fit(langid.training_rows(docs))
    known = langid.with_language(docs, model)
    return known.filter((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies."""
    found = minhash.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    stay = found.filter("kept").select(F.col("row_key").alias("__key")).distinct()
    return docs.join(stay, minhash.row_key(F.col("doc_id"), F.col("text")) == F.col("__key"), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or repeated."""
    _, plan = mixing.mix(docs)
    return mixing.repeated(docs, plan)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row per document."""
    return token_ids.token_files(docs, vocabulary_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Training a classifier and encoding tokens are no SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
