"""The operators over whole tables, as the driver calls them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, exact, fingerprints, html_text, langid, merkle, minhash, mixing, substring, suffix, token_ids, url_filter
from .oracle import ORACLE
from .tables import table

__all__ = ["ORACLE", "QUERIES", "vocabulary_path"]

#: File of the public vocabulary that op2 encodes with.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring.remove_repeats(docs, width=13, with_text=False).select(*substring.DIGEST)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_ids.token_files(docs, vocabulary_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix.remove_repeats(docs, length=200, with_text=False).select(*suffix.DIGEST)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), altered=altered, with_proof=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_ids": op2_token_ids,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_fingerprints": op12_fingerprints,
    "op13_merkle_manifest": op13_merkle_manifest,
}
