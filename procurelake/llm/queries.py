"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm import bpe, debruijn, decontaminate, filteraudit, htmltext, langid, linededup, merkle, neardupvec, quality, secrets, simhash, tokenstore


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardupvec.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_digests(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.dedup_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_secrets": op7_secrets,
    "op8_token_store": op8_token_store,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op11_substring_dedup": debruijn.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
