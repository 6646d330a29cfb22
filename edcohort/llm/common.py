"""Shared helpers of the corpus operators: staging, table access, native text
expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: The white space of the word and line rules: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: The same set as a Java/RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Workspace:
    """Intermediate tables of one run, in a folder of its own below the shared
    ``spark.checkpoint.dir``.

    ``put`` writes a DataFrame as Parquet and returns it read back, which cuts
    the lineage: a lost executor costs only the tasks that read the table.
    Spark's commit protocol keeps partial or speculative attempts out.
    Very large rows ask for few ``rows_per_file``: Parquet's pages and batches
    would else hold a hundred of them and more. ``drop`` deletes a table that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("error")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string): further columns of the
    input, whatever their names, take no part in the work."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row. An array used inside a
    lambda would otherwise be inlined there and evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the maximal runs outside ``SPACE_CLASS`` (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Array of the sums of all earlier elements (exclusive prefix sums), by
    block sums and sums within a block, so long arrays stay far from
    quadratic work."""
    def plus(a: Column, x: Column) -> Column:
        return a + x

    zero = F.lit(0).cast("long")

    def run(v: Column) -> Column:
        n = F.size(v)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / F.lit(block)).cast("int")),
            lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), zero, plus))
        return let(blocks, lambda s: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.aggregate(F.slice(s, F.lit(1), F.floor(i / F.lit(block)).cast("int")), zero, plus)
            + F.aggregate(F.slice(v, F.floor(i / F.lit(block)).cast("int") * block + 1, i % F.lit(block)),
                          zero, plus)))

    empty = F.array().cast(T.ArrayType(T.LongType()))
    longs = lengths.cast(T.ArrayType(T.LongType()))
    return let(longs, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(empty))
