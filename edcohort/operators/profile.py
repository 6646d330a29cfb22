"""Profiling and validation reports (S7, S12, A6, A7, A13, A14, A17, A18,
A29–A34).

Every report is one aggregate (or one grouped aggregate) over the data,
turned into long form afterwards; no per-column jobs and nothing collected.
Exact percentiles come from ``quantiles`` (value counts first, then distributed
selection, or one buffer per group for columns said to have a ``bounded``
domain); ``exact=False`` uses ``percentile_approx`` instead (a fixed-size sketch
per group, one pass fewer).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import melt, pct, safe_div, to_long
from ..sources.schemas import has
from .quantiles import global_quantiles, quantile_frame, value_frequencies

PCTS = [0.25, 0.5, 0.75, 0.95]


def _quantiles_by(df: DataFrame, col: str, ps: list[float], by: str | None, exact: bool, bounded: bool):
    """Quantile arrays per group (frame) or, without a group, as a scalar."""
    if by:
        return quantile_frame(df, col, ps, [by], exact, bounded)
    return global_quantiles(df, col, ps, exact, bounded)


def cohort_summary(df: DataFrame) -> DataFrame:
    """One row: size, patients, age, sex shares, LOS, label shares."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n_rows"), F.count_distinct("subject_id").alias("n_patients")]
    if has(df, "age_at_ed"):
        aggs += [F.avg("age_at_ed").alias("age_mean"), F.min("age_at_ed").alias("age_min"),
                 F.max("age_at_ed").alias("age_max")]
    if has(df, "gender"):
        aggs += [pct(F.count_if(F.col("gender") == "M"), n).alias("pct_male"),
                 pct(F.count_if(F.col("gender") == "F"), n).alias("pct_female")]
    if has(df, "ed_los_hours"):
        aggs += [F.avg("ed_los_hours").alias("los_mean"),
                 global_quantiles(df, "ed_los_hours", [0.5])[0].alias("los_median")]
    if has(df, "lengthened_ed_stay"):
        aggs.append(pct(F.count_if(F.col("lengthened_ed_stay") == 1), n).alias("pct_lengthened"))
    if has(df, "hospital_death"):
        aggs.append(pct(F.count_if(F.col("hospital_death") == 1), n).alias("pct_death"))
    return df.agg(*aggs)


def run_stats(df: DataFrame, outcome: str = "critical_outcome") -> DataFrame:
    """Rows, patients, outcome %, mean age, mean LOS (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct("subject_id").alias("n_patients"),
                  (F.avg(F.col(outcome).cast("double")) * 100.0).alias("outcome_pct"),
                  F.avg("age_at_ed").alias("age_mean"),
                  F.avg("ed_los_hours").alias("los_mean"))


def feature_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature completeness %, mean, sample std, min, max (long
    form first, so one narrow aggregate keyed by feature)."""
    n = df.select(F.count(F.lit(1))).scalar()
    long = melt(df, cols).groupBy("feature").agg(
        F.count("x").alias("non_null"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max")).withColumn("__n", n)
    kind = F.when(F.col("feature").startswith("triage_"), F.lit("Triage")).otherwise(F.lit("Laboratory"))
    return long.select("feature", kind.alias("kind"),
                       pct("non_null", "__n").alias("completeness_pct"),
                       "mean", "std", "min",
                       "max")


def describe(df: DataFrame, cols: list[str], by: str | None = None, exact: bool = True,
             bounded: bool = False) -> DataFrame:
    """Count, mean, std, min, p25, p50, p75, max, p95 per column
    (optionally per group), long form: one row per (group, column)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"),
                 F.max(x).alias(f"{c}|max")]
    wide = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    for c in cols:
        q = _quantiles_by(df, c, PCTS, by, exact, bounded)
        if by:
            wide = wide.join(q.withColumnRenamed("q", f"{c}|p"), by, "left")
        else:
            wide = wide.withColumn(f"{c}|p", q)
    rows = [(c, F.col(f"`{c}|count`"), F.col(f"`{c}|mean`"), F.col(f"`{c}|std`"), F.col(f"`{c}|min`"),
             F.col(f"`{c}|p`")[0], F.col(f"`{c}|p`")[1], F.col(f"`{c}|p`")[2], F.col(f"`{c}|max`"),
             F.col(f"`{c}|p`")[3]) for c in cols]
    names = ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "p95"]
    long = to_long(wide, rows, names, keep=[by] if by else None)
    return long.select(*([by] if by else []), "column", "count",
                       *names[2:])


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table (one union of counts; the column
    count comes from the schema)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Counts per value (nulls dropped, as pandas does)."""
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = df.where(F.col(col).isNotNull()).select(F.count(F.lit(1))).scalar()
        out = out.withColumn("share", safe_div(F.col("n"), F.lit(total)))
    return out.orderBy(F.desc("n"), col)


def completeness(df: DataFrame, cols: list[str] | None = None,
                 expected: list[str] | None = None) -> DataFrame:
    """Non-null count, % and missing count per column in one
    aggregate; expected-but-absent columns are reported from the schema."""
    cols = cols or df.columns
    present = [c for c in cols if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(f"{c}|nn") for c in present])
    rows = [(c, F.lit(df.schema[c].dataType.simpleString()), F.col(f"`{c}|nn`"), F.lit(True))
            for c in present]
    rows += [(c, F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(False))
             for c in (expected or []) if c not in df.columns]
    long = to_long(wide, rows, ["column", "dtype", "non_null", "present"], keep=["__n"])
    return long.select("column", "dtype", "present", F.col("non_null").cast("long").alias("non_null"),
                       (F.col("__n") - F.col("non_null")).cast("long").alias("missing"),
                       pct("non_null", "__n").alias("completeness_pct")).orderBy(
                           F.desc("completeness_pct"), "column")


def column_metadata(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type, null % and basic statistics per column (numeric columns get
    mean/min/max; others null)."""
    cols = cols or df.columns
    num = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"{c}|nn"))
        if c in num:
            aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}|mean"),
                     F.min(F.col(c).cast("double")).alias(f"{c}|min"),
                     F.max(F.col(c).cast("double")).alias(f"{c}|max")]
    wide = df.agg(*aggs)
    nul = F.lit(None).cast("double")
    rows = [(c, F.lit(df.schema[c].dataType.simpleString()), F.col(f"`{c}|nn`"),
             F.col(f"`{c}|mean`") if c in num else nul, F.col(f"`{c}|min`") if c in num else nul,
             F.col(f"`{c}|max`") if c in num else nul) for c in cols]
    long = to_long(wide, rows, ["column", "dtype", "non_null", "mean", "min", "max"], keep=["__n"])
    return long.select("column", "dtype",
                       pct(F.col("__n") - F.col("non_null"), "__n").alias("null_pct"),
                       "mean", "min", "max")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins (the
    maximum falls in the last bin; a constant column spans ±0.5). All bins
    are returned, empty ones with 0. Min/max come from a one-row aggregate
    read as scalar subqueries (no join)."""
    x = F.col(col).cast("double")
    stats = df.agg(F.min(x).alias("lo0"), F.max(x).alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    lo, hi = stats.select("lo").scalar(), stats.select("hi").scalar()
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull())
    b = F.least(F.width_bucket(F.col("v"), lo, hi, F.lit(bins)), F.lit(bins))
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = stats.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (edges.join(counts, "bin", "left")
                 .select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                         (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
                         F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box_stats(df: DataFrame, value: str, by: str, exact: bool = True, bounded: bool = False) -> DataFrame:
    """Quartiles per group, 1.5·IQR whiskers (most extreme values
    inside the fences) and the outlier count. The quartiles meet the counts per
    (group, value), which are combined before any shuffle, not the rows."""
    vals = df.select(F.col(by), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    q = quantile_frame(vals, "v", [0.25, 0.5, 0.75], [by], exact, bounded)
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = value_frequencies(vals, "v", [by]).join(q, by)
    inside = (F.col("__v") >= lo_f) & (F.col("__v") <= hi_f)
    out = j.groupBy(by, "q1", "median", "q3").agg(
        F.sum("__k").alias("n"),
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("__k"))).cast("long").alias("n_outliers"))
    return out.select(by, "n", "q1", "median", "q3", "whisker_lo", "whisker_hi",
                      "n_outliers")


def row_loss(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per stage and rows lost versus the first stage (one union)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n_rows") for i, (name, df) in enumerate(stages)]
    u = reduce(DataFrame.unionByName, parts)
    n_first = stages[0][1].select(F.count(F.lit(1))).scalar()
    return u.select("stage_no", "stage", "n_rows", (n_first - F.col("n_rows")).alias("rows_lost"))


def observed_row_loss(spark: SparkSession, counts: list[tuple[str, int]]) -> DataFrame:
    """A33 from row counts observed while the stages were written."""
    rows = [(i, name, n, counts[0][1] - n) for i, (name, n) in enumerate(counts)]
    return spark.createDataFrame(rows, "stage_no int, stage string, n_rows long, rows_lost long")


def lab_utilization_pct(df: DataFrame, groups: list[str]) -> DataFrame:
    """% of stays with each group ordered; mean groups; stays with none."""
    aggs = [F.count(F.lit(1)).alias("__n"),
            F.avg("total_lab_groups_ordered").alias("__mean_groups"),
            F.count_if(F.col("total_lab_groups_ordered") == 0).alias("__none")]
    aggs += [F.avg(F.col(f"lab_{g}_ordered").cast("double")).alias(g) for g in groups]
    wide = df.agg(*aggs)
    rows = [(g, F.col(g) * 100.0) for g in groups]
    long = to_long(wide, rows, ["lab_group", "pct_ordered"], keep=["__mean_groups", "__none"])
    return long.select("lab_group", "pct_ordered",
                       F.col("__mean_groups").alias("mean_groups_per_stay"),
                       F.col("__none").alias("stays_without_labs"))


def source_profile(sources: dict[str, DataFrame]) -> DataFrame:
    """Per source and column: type and non-null count (one aggregate per
    source, unioned)."""
    parts = []
    for name, df in sources.items():
        wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(f"{c}|nn") for c in df.columns])
        rows = [(F.lit(name), c, F.lit(df.schema[c].dataType.simpleString()), F.col(f"`{c}|nn`"))
                for c in df.columns]
        parts.append(to_long(wide, rows, ["source", "column", "dtype", "non_null"], keep=["__n"])
                     .withColumnRenamed("__n", "n_rows"))
    return reduce(DataFrame.unionByName, parts)
