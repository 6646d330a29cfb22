"""Corpus preparation in stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents:

1. quality: rejects documents of high perplexity (model trained on the trusted
   labels of ``sf_dir``);
2. lines: drops lines that many documents share, but for one document each;
3. near_duplicates: keeps one document of each group of near copies;
4. secrets: masks every secret's span in the texts;
5. packing: tokenises and packs what is left into sequences of 4096 ids.

A changed text gets a new ``n_chars`` where that column exists. Rows with a
null doc_id pass stages 2 to 4 by themselves (no id to group them by); of rows
with a repeated doc_id stage 3 keeps one. Null texts are rejected by stage 1,
and an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edcohort.llm.common import Workspace, table
from edcohort.llm.line_dedup import dedup_lines
from edcohort.llm.minhash import near_duplicates
from edcohort.llm.packing import pack
from edcohort.llm.perplexity import keep_good
from edcohort.llm.secret_scan import masked, scan


def _with_text(docs: DataFrame, rows: DataFrame, changed, text) -> DataFrame:
    """The ``doc`` structs of ``rows`` as rows like ``docs``, with a new text
    and length where ``changed``."""
    doc = F.col("doc")
    out = doc.withField("text", F.when(changed, text).otherwise(F.col("doc.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withField("n_chars", F.when(changed, F.char_length(text).cast(kind))
                            .otherwise(F.col("doc.n_chars")))
    return rows.select(out.alias("doc")).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs).withColumn("left", F.col("doc.text"))
    return _with_text(docs, cleaned, F.col("n_dropped") > 0, F.col("left"))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    members = near_duplicates(spark, docs)
    gone = members.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    left = rows.join(gone.hint("shuffle_hash"), F.col("id") == F.col("gone_id"), "left_anti")
    twice = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1")
    if not twice.isEmpty():
        order = Window.partitionBy("id").orderBy(F.xxhash64("doc.text"))
        left = left.withColumn("n", F.row_number().over(order)).filter("id IS NULL OR n = 1")
    return left.select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan(docs)
    return _with_text(docs, found, F.size("spans") > 0, masked(F.col("text"), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", duplicates),
          ("secrets", secrets), ("packing", packing)]

#: Perplexity, MinHash links and packing have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
