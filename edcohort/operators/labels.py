"""Outcome labels (O1–O5, J6) and label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import melt, pearson, to_long
from ..functions.frames import pct as pct_of
from ..functions.timecols import add_hours, hours_between, parse_timestamp
from ..sources.readers import STAY_KEYS, check_input
from ..sources.schemas import has
from .intervals import window_join

# --- fixed values: published label rates (percent) and the accepted drift ---
PUBLISHED_PCT = {"critical_outcome": 9.67, "lengthened_ed_stay": 6.90,
                 "hospital_death": 1.44, "icu_transfer_12h": 8.94}
ACCEPTED_DRIFT_POINTS = 5.0
LABEL_COLS = ["hospital_death", "icu_transfer_12h", "critical_outcome", "lengthened_ed_stay"]
ID_COLS = ["stay_id", "subject_id", "hadm_id"]
ICU_WINDOW_HOURS = 12.0


def hospital_death(df: DataFrame) -> DataFrame:
    """O1: expire flag (null → 0), else deathtime present, else a date of
    death within one (floored) day of discharge, else 0."""
    if has(df, "hospital_expire_flag"):
        death = F.coalesce(F.col("hospital_expire_flag").cast("int"), F.lit(0))
    elif has(df, "deathtime"):
        death = F.col("deathtime").isNotNull().cast("int")
    elif has(df, "dod", "dischtime"):
        days = F.floor(hours_between(parse_timestamp("dischtime"), parse_timestamp("dod")) / 24.0)
        death = F.coalesce(parse_timestamp("dod").isNotNull() & (F.abs(days) <= 1),
                           F.lit(False)).cast("int")
    else:
        death = F.lit(0)
    return df.withColumn("hospital_death", death)


def icu_matches(stays: DataFrame, icustays: DataFrame, hours: float = ICU_WINDOW_HOURS,
                anchor: str = "outtime") -> DataFrame:
    """J6 core: distinct stays with an ICU admission 0–``hours`` h after
    ``anchor``, joined on the admission key and time bucket."""
    s = (stays.select("stay_id", "subject_id", "hadm_id", parse_timestamp(anchor).alias("__anchor"))
         .withColumn("__end", add_hours("__anchor", float(hours))))
    icu = icustays.select("subject_id", "hadm_id", parse_timestamp("intime").alias("__icu_in"))
    h = hours_between("__anchor", "__icu_in")
    met = window_join(icu, s, ["subject_id", "hadm_id"], "__icu_in", "__anchor", "__end", max(float(hours), 1.0))
    return (met.where((h >= 0) & (h <= float(hours)))
             .select("stay_id").distinct())


def icu_transfer(df: DataFrame, icustays: DataFrame | None, hours: float = ICU_WINDOW_HOURS,
                 anchor: str = "outtime", keys: DataFrame | None = None) -> DataFrame:
    """O2: ``icu_transfer_12h`` = 1 when such an ICU stay exists (no fan-out:
    the matches are distinct stays before the join back). ``keys`` is an
    optional narrow frame of the same stays for the existence join."""
    if icustays is None:
        return df.withColumn("icu_transfer_12h", F.lit(0))
    hits = icu_matches(keys if keys is not None else df, icustays, hours, anchor).withColumn("__hit", F.lit(1))
    return (df.join(hits, "stay_id", "left")
              .withColumn("icu_transfer_12h", F.coalesce("__hit", F.lit(0))).drop("__hit"))


def critical_outcome(df: DataFrame) -> DataFrame:
    """O3: death OR ICU transfer."""
    return df.withColumn("critical_outcome",
                         ((F.col("hospital_death") == 1) | (F.col("icu_transfer_12h") == 1)).cast("int"))


def lengthened_stay(df: DataFrame) -> DataFrame:
    """LOS > 24 h; without ``ed_los_hours`` the raw (unclamped) LOS is used."""
    if has(df, "ed_los_hours"):
        los = F.col("ed_los_hours")
    elif has(df, "intime", "outtime"):
        df = df.withColumn("ed_los_hours", hours_between(parse_timestamp("intime"),
                                                         parse_timestamp("outtime")))
        los = F.col("ed_los_hours")
    else:
        return df.withColumn("lengthened_ed_stay", F.lit(0))
    return df.withColumn("lengthened_ed_stay", F.coalesce(los > 24, F.lit(False)).cast("int"))


def create_all_labels(df: DataFrame, icustays: DataFrame | None,
                      icu_hours: float = ICU_WINDOW_HOURS, keys: DataFrame | None = None) -> DataFrame:
    """All labels. P19: the stays must carry their keys."""
    check_input(df, "stays", STAY_KEYS, non_empty=False)
    return (df.transform(hospital_death).transform(icu_transfer, icustays, icu_hours, "outtime", keys)
              .transform(critical_outcome).transform(lengthened_stay))


# ---------------------------------------------------------------- reports

def label_summary(df: DataFrame) -> DataFrame:
    """Positives / negatives per label with the published rate."""
    labels = [c for c in ("critical_outcome", "lengthened_ed_stay") if has(df, c)]
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in labels])
    rows = [(lbl, F.col(lbl), F.lit(PUBLISHED_PCT[lbl])) for lbl in labels]
    long = to_long(agg, rows, ["label", "n_pos", "paper_pct"], keep=["n"])
    pct = pct_of("n_pos", "n")
    return long.select("label", F.col("n_pos").cast("long").alias("n_pos"), pct.alias("pct_pos"),
                       (F.col("n") - F.col("n_pos")).cast("long").alias("n_neg"),
                       (F.lit(100.0) - pct).alias("pct_neg"), "paper_pct")


def label_overlap(df: DataFrame) -> DataFrame:
    """Label counts and the death ∧ ICU overlap, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("critical_outcome") == 1).alias("n_critical"),
        F.count_if(F.col("hospital_death") == 1).alias("n_death"),
        F.count_if(F.col("icu_transfer_12h") == 1).alias("n_icu"),
        F.count_if((F.col("hospital_death") == 1) & (F.col("icu_transfer_12h") == 1)).alias("n_death_and_icu"),
        F.count_if(F.col("lengthened_ed_stay") == 1).alias("n_lengthened"),
    )


def crosstab_margins(df: DataFrame, row: str = "critical_outcome",
                     col: str = "lengthened_ed_stay") -> DataFrame:
    """A10: crosstab with margins via CUBE; margins are labelled 'All'."""
    c = df.cube(row, col).agg(F.count(F.lit(1)).alias("n"),
                              F.grouping(row).alias("gr"), F.grouping(col).alias("gc"))
    return c.select(F.when(F.col("gr") == 1, F.lit("All")).otherwise(F.col(row).cast("string")).alias(row),
                    F.when(F.col("gc") == 1, F.lit("All")).otherwise(F.col(col).cast("string")).alias(col),
                    "n")


def crosstab_normalized(df: DataFrame, row: str = "critical_outcome",
                        col: str = "lengthened_ed_stay") -> DataFrame:
    """A10: column-normalised crosstab in percent (share within each column).
    The window runs over the tiny count table only."""
    from pyspark.sql import Window
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(col)
    return counts.select(row, col, "n", pct_of(F.col("n"), F.sum("n").over(w)).alias("pct_of_col"))


def label_rate_check(df: DataFrame) -> DataFrame:
    """Observed rate vs published rate, within ±5 points."""
    labels = [c for c in ("critical_outcome", "lengthened_ed_stay") if has(df, c)]
    agg = df.agg(*[F.avg(c).alias(c) for c in labels])
    rows = [(lbl, F.col(lbl) * 100.0, F.lit(PUBLISHED_PCT[lbl])) for lbl in labels]
    long = to_long(agg, rows, ["label", "rate_pct", "paper_pct"])
    diff = F.col("rate_pct") - F.col("paper_pct")
    return long.select("label", "rate_pct", "paper_pct", diff.alias("diff_points"),
                       (F.abs(diff) < ACCEPTED_DRIFT_POINTS).alias("within_tolerance"))


def numeric_features(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns minus ids and labels (schema only)."""
    skip = set(ID_COLS + LABEL_COLS + (exclude or []))
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def label_correlations(df: DataFrame, labels: list[str] | None = None, top: int = 10,
                       features: list[str] | None = None, signed: bool = False) -> DataFrame:
    """Pearson correlation (pairwise complete) of every numeric feature
    with each label, top ``top`` per label by absolute value (ties by name); the
    notebook variant keeps the sign.

    The features are unpivoted and one aggregate keyed by feature holds the
    co-moments with all labels: a handful of numbers per feature, in code small
    enough to be compiled, combined inside each task, so the input is read once
    and never shuffled."""
    from pyspark.sql import Window
    labels = [c for c in (labels or ["critical_outcome", "lengthened_ed_stay"]) if has(df, c)]
    feats = features or numeric_features(df)
    pairs = melt(df.withColumns({f"__y{i}": F.col(c).cast("double") for i, c in enumerate(labels)}), feats,
                 keep=[f"__y{i}" for i in range(len(labels))]).where(F.col("x").isNotNull())
    moments = pairs.groupBy("feature").agg(*[pearson(F.col("x"), F.col(f"__y{i}")).alias(f"__c{i}")
                                             for i in range(len(labels))])
    long = to_long(moments, [(c, F.col(f"__c{i}")) for i, c in enumerate(labels)], ["label", "corr"], keep=["feature"])
    long = long.where(F.col("corr").isNotNull()).withColumn("abs_corr", F.abs("corr"))
    # twelve places decide the order (beyond them lies rounding noise of scaled
    # copies of a feature); the table is features x labels, so one small
    # partition per label
    key = F.round("corr" if signed else "abs_corr", 12).desc()
    w = Window.partitionBy("label").orderBy(key, F.col("feature"))
    ranked = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("label", "rank", "feature", "corr", "abs_corr")
