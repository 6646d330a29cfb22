"""Registered queries of the corpus operators: name -> (spark, sf_dir) ->
DataFrame, and their SQL where SQL can express them. Each applies one operator
with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, language_id, lexical_search, line_dedup, minhash, neighbours, packing, perplexity, quality_rules,
               secret_scan, sharding, spelling, token_files)
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(spark, table(spark, sf_dir, "documents"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules_report(spark, table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark, table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    f.__name__: f for f in (op1_minhash, op2_token_files, op3_perplexity, op4_secret_scan, op5_quality_rules,
                            op6_packing, op7_bpe, op8_language_id, op9_neighbours, op10_line_dedup,
                            op11_lexical_search, op12_sharding, op13_spelling)
}

SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op13_spelling": spelling.SQL,
}
