"""Sinks (S9–S11) and stage tables.

Stage tables are how long plans are cut: a written Parquet table in the
shared checkpoint folder (``spark.checkpoint.dir``) survives the loss of any
executor, unlike cached or locally checkpointed data, and later stages read
it back with a short lineage.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Snappy Parquet, optionally one folder per split/partition value."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_summary_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header for small summary tables (aggregates only), as
    one file."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_stage(df: DataFrame, name: str, spark: SparkSession | None = None,
                root: str | None = None, run_id: str | None = None) -> DataFrame:
    """Write ``df`` as a stage table under the shared checkpoint folder and
    return the table read back (lineage cut, recomputation-free reuse). Each
    run has a folder of its own, so two runs never touch each other's tables."""
    spark = spark or df.sparkSession
    root = root or os.path.join(ensure_checkpoint_dir(spark), "stages", run_id or uuid.uuid4().hex)
    path = os.path.join(root, name)
    write_parquet(df, path)
    return spark.read.parquet(path)


def write_observed(df: DataFrame, name: str, metrics: list[Column], spark: SparkSession | None = None,
                   root: str | None = None, run_id: str | None = None) -> tuple[DataFrame, dict]:
    """``write_stage``, and the values of the aggregates ``metrics`` (each with
    an alias) over the rows written, observed while they pass: nothing is read
    again. The observation is the last node before the sink, where Spark counts
    every task once, however often it is tried. A plan that Spark finds empty
    may drop the observation; the written (empty) table is then asked."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    stage = write_stage(df.observe(seen, *metrics), name, spark, root, run_id)
    return stage, seen.get or stage.agg(*metrics).first().asDict()


def manifest_metrics(outcome: str = "outcome") -> list[Column]:
    """The aggregates of the manifest over the split table."""
    aggs = [F.count(F.lit(1)).alias("n_total"),
            F.avg(F.col("has_text").cast("double")).alias("text_coverage")]
    for s in ("train", "val", "test"):
        in_s = F.col("split") == s
        aggs += [F.count_if(in_s).alias(f"n_{s}"),
                 F.count_if(in_s & (F.col(outcome) == 1)).alias(f"pos_{s}"),
                 (F.avg(F.when(in_s, F.col(outcome).cast("double"))) * 100.0).alias(f"rate_{s}")]
    return aggs


def run_manifest(split_df: DataFrame, config: dict, outcome: str = "outcome") -> DataFrame:
    """One row: size, positives and rate per split, text coverage and
    the run configuration (as JSON text)."""
    return split_df.agg(*manifest_metrics(outcome)).withColumn("config", F.lit(json.dumps(config, sort_keys=True)))


def observed_manifest(spark: SparkSession, values: dict, config: dict) -> DataFrame:
    """``run_manifest`` from observed ``manifest_metrics``."""
    kinds = {c: "long" if c.startswith(("n_", "pos_")) else "double" for c in values}
    row = (*values.values(), json.dumps(config, sort_keys=True))
    return spark.createDataFrame([row], ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "config string"]))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)
