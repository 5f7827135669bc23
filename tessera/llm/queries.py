"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL
from corpus_pipeline import run as pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_automaton, language_id, licenses, line_dedup, ngram_join, packing, substring_dedup, syncmers, token_files, topk
from tessera.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source's directory."""
    docs = documents(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return licenses.scan(docs, keys=("doc_id",))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(documents(spark, sf_dir))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_bpe_automaton, op4_token_files, op5_packing, op6_license_scan, op7_ngram_join, op8_syncmers, op9_topk, op10_substring_dedup)} | {"pipeline": pipeline}
SQL = {"op2_line_dedup": line_dedup.SQL, "op9_topk": topk.SQL} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
