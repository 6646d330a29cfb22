"""Clinical-shaped tables derived from the driver's synthetic tables.

The clinical sources cannot be redistributed, so tests and benchmarks derive
tables of the same shapes from the given star schema. All work here is
narrow projections plus two joins, so the derived tables grow with the
inputs. Nulls, out-of-range stays, non-numeric values and window edges are
planted on purpose so every rule of the operators is exercised.

The DuckDB twin of this mapping lives in ``edcohort.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labdim import lab_dim
from .readers import Tables


#: Added to a document id for the note without text beside it.
BLANK_NOTES = 1_000_000_000_020


def _hours(ts: str | Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts if isinstance(ts, Column) else F.col(ts))


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def edstays_from(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    out_offset = (k % 24) + F.when(k % 50 == 0, F.lit(-2)).when(k % 50 == 1, F.lit(200)).otherwise(k % 36)
    return orders.select(
        k.alias("stay_id"),
        F.col("o_custkey").alias("subject_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("long"))
         .otherwise(F.lit(20000000).cast("long") + k).alias("hadm_id"),
        _hours("o_orderdate", k % 24).alias("intime"),
        _hours("o_orderdate", out_offset).alias("outtime"),
    )


def patients_from(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("subject_id"),
        F.when(k % 97 == 0, F.lit(None).cast("string"))
         .when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        (F.lit(10) + k % 85).cast("int").alias("anchor_age"),
        F.lit(1995).alias("anchor_year"),
    )


def triage_from(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")

    def vital(stride: int, base: int, mod: int, scale: float | None = None) -> Column:
        v = (F.lit(base) + (k % mod) / F.lit(scale)) if scale else (F.lit(base) + k % mod).cast("double")
        return F.when(k % stride == 0, F.lit(None).cast("double")).otherwise(v.cast("double"))

    return orders.select(
        k.alias("stay_id"),
        vital(11, 96, 60, 10.0).alias("temperature"),
        vital(7, 50, 90).alias("heartrate"),
        vital(5, 10, 20).alias("resprate"),
        vital(3, 85, 16).alias("o2sat"),
        vital(4, 90, 100).alias("sbp"),
        vital(13, 50, 60).alias("dbp"),
        (F.lit(1) + k % 5).cast("double").alias("acuity"),
        F.when(k % 9 == 0, F.lit("unable")).otherwise((k % 11).cast("string")).alias("pain"),
        F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("chiefcomplaint"),
    )


def admissions_from(edstays: DataFrame) -> DataFrame:
    s = F.col("stay_id")
    return edstays.where(F.col("hadm_id").isNotNull()).select(
        "subject_id", "hadm_id",
        F.col("outtime").alias("admittime"),
        _hours("outtime", 24 * (F.lit(1) + s % 9)).alias("dischtime"),
        F.when(s % 70 == 2, F.lit(1)).when(s % 70 == 3, F.lit(None).cast("int"))
         .otherwise(F.lit(0)).alias("hospital_expire_flag"),
    )


def icustays_from(edstays: DataFrame) -> DataFrame:
    s = F.col("stay_id")
    return edstays.where(F.col("hadm_id").isNotNull() & (s % 10 == 3)).select(
        "subject_id", "hadm_id",
        (F.lit(30000000).cast("long") + s).alias("icu_stay_id"),
        _hours("outtime", s % 30 - 5).alias("intime"),
    )


def labevents_from(lineitem: DataFrame, edstays: DataFrame, dim: DataFrame) -> DataFrame:
    """Each line item becomes one lab result of its order's stay; parts
    without a configured item get item id 99999, and the fifth line of an
    order a small decimal value.

    ``dim`` is the fixed 56-row item dimension: broadcasting it is bounded by
    construction. The stay join is a shuffle join on the order key.
    """
    li = lineitem.select(
        F.col("l_orderkey").alias("stay_id"),
        (F.col("l_partkey") % 58).cast("int").alias("pos"),
        "l_linenumber", "l_quantity", "l_tax")
    joined = (li.join(edstays.select("stay_id", "subject_id", "hadm_id", "intime"), "stay_id")
                .join(F.broadcast(dim.select("pos", "itemid")), "pos", "left"))
    value = F.when(F.col("l_linenumber") == 5, F.col("l_quantity") / 100000).otherwise(F.col("l_quantity"))
    return joined.select(
        "subject_id", "hadm_id", F.coalesce("itemid", F.lit(99999)).alias("itemid"),
        _hours("intime", F.col("l_linenumber") * 3 - 4).alias("charttime"),
        F.when(F.col("l_tax") == 0.08, F.lit(None).cast("double")).otherwise(value).alias("valuenum"),
    )


def vitalsign_from(events: DataFrame, edstays: DataFrame) -> DataFrame:
    """Each event becomes a vital-sign row; about half of them belong to stays
    that do not exist, and a column stands beside the eleven."""
    e = F.col("event_id")
    n_stays = edstays.select(F.count(F.lit(1))).scalar()

    def vital(stride: int, base: int, mod: int) -> Column:
        return F.when(e % stride != 0, (F.lit(base) + e % mod).cast("double"))

    return events.select(
        F.col("user_id").alias("subject_id"), F.pmod(e * 7919, 2 * n_stays).alias("stay_id"),
        F.col("ts").cast("timestamp_ntz").alias("charttime"), vital(11, 96, 8).alias("temperature"),
        vital(7, 50, 90).alias("heartrate"), vital(5, 10, 20).alias("resprate"), vital(3, 85, 16).alias("o2sat"),
        vital(4, 90, 100).alias("sbp"), vital(13, 50, 60).alias("dbp"), F.col("event_type").alias("rhythm"),
        F.when(e % 9 == 0, F.lit("unable")).otherwise((e % 11).cast("string")).alias("pain"),
        F.col("value").alias("not_loaded"))


def notes_from(documents: DataFrame, edstays: DataFrame) -> DataFrame:
    """Documents become notes: three consecutive documents share a stay, and
    the stays are spread over the whole stay range (a scalar subquery gives
    the stay count), so no stay collects an outsized share of the notes. Some
    notes without text stand beside them."""
    d = F.col("doc_id")
    n_stays = edstays.select(F.count(F.lit(1))).scalar()
    source = documents.select(d, "text", d.alias("of"))
    blank = documents.where(d % 31 == 0).select(
        d + BLANK_NOTES, F.lit(None).cast("string").alias("text"), d.alias("of"))
    docs = source.union(blank).select(
        "doc_id", "text", F.pmod(F.floor(F.col("of") / 3) * 7919, n_stays).alias("stay_id"))
    joined = docs.join(edstays.select("stay_id", "subject_id", "hadm_id", "intime"), "stay_id")
    is_ds = d % 4 == 0
    return joined.select(
        d.cast("string").alias("note_id"),
        "subject_id", "hadm_id",
        F.when(is_ds, F.lit("DS")).otherwise(F.lit("RR")).alias("note_type"),
        F.when(is_ds, F.lit("discharge")).otherwise(F.lit("radiology")).alias("note_category"),
        F.when(is_ds, F.lit(1)).otherwise(F.lit(2)).alias("category_priority"),
        _hours("intime", (d * 5) % 60 - 6).alias("charttime"),
        "text",
    )


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    orders = read_driver(spark, sf_dir, "orders")
    stays = edstays_from(orders)
    dim = lab_dim(spark)
    return Tables(
        edstays=stays,
        patients=patients_from(read_driver(spark, sf_dir, "customer")),
        triage=triage_from(orders),
        admissions=admissions_from(stays),
        icustays=icustays_from(stays),
        labevents=labevents_from(read_driver(spark, sf_dir, "lineitem"), stays, dim),
        notes=notes_from(read_driver(spark, sf_dir, "documents"), stays),
        extra={"lab_dim": dim},
    )


def d_labitems_from(part: DataFrame, dim: DataFrame) -> DataFrame:
    """An item dictionary derived from the part table: the configured item
    at position ``p_partkey % 58`` of every part, but those whose item id
    leaves 3 on division by 7."""
    p = part.select(
        (F.col("p_partkey") % 58).cast("int").alias("pos"), F.col("p_name").alias("label"))
    return (p.join(F.broadcast(dim.select("pos", "itemid")), "pos").where(F.col("itemid") % 7 != 3)
             .groupBy("itemid").agg(F.min("label").alias("label")))
