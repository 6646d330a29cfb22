"""Laboratory features.

Plan shape at scale: lab events (the one large table) are reduced at the scan
(relevant items, non-null value), joined to the cohort on the admission key
and time bucket (``intervals``: a long history is spread over tasks), tagged
with their group by a broadcast of the fixed 56-row item dimension, and reduced
by two hash aggregates: one value per (stay, group, order key), which settles
ties, then the pivot keyed by ``stay_id``, whose per-group picks are filtered
``min_by`` terms over that key. Keys and buffers are numbers only, so both
combine rows map-side without a sort, a hot stay is spread over its keys, and
the result is partitioned by ``stay_id`` for the join back to the cohort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import pct
from ..functions.timecols import MICROS_PER_HOUR, add_hours, hours_between, parse_number, parse_timestamp
from ..sources.labdim import GROUP_MINUTES, LAB_GROUP_ITEMS, LAB_GROUPS, lab_dim
from ..sources.readers import STAY_KEYS, check_input, scan_labevents
from ..sources.schemas import has
from .intervals import window_join

# --- fixed values: weights of the mixed time-cost estimate ---
PARALLEL_WEIGHT = 0.7
SEQUENTIAL_WEIGHT = 0.3


def value_col(g: str) -> str:
    return f"lab_{g}_value"


def time_col(g: str) -> str:
    return f"lab_{g}_time"


def ordered_col(g: str) -> str:
    return f"lab_{g}_ordered"


WIDE_COLS = [c for g in LAB_GROUPS for c in (value_col(g), time_col(g))]
FLAG_COLS = [ordered_col(g) for g in LAB_GROUPS]


def labs_in_window(labs: DataFrame, stays: DataFrame, hours: float = 12.0) -> DataFrame:
    """Labs ⋈ stays on (subject_id, hadm_id), kept when
    0 ≤ charttime − intime ≤ ``hours``; adds ``stay_id`` and ``hours_from_ed``.

    Several stays under one admission each get the lab (each stay judges its
    own window). Null keys never match. The time bucket is part of the join
    key, so a long history is spread over tasks.
    """
    s = (stays.select("stay_id", "subject_id", "hadm_id", parse_timestamp("intime").alias("intime"))
         .withColumn("__end", add_hours("intime", float(hours))))
    l = labs.select("subject_id", "hadm_id", "itemid", parse_timestamp("charttime").alias("charttime"),
                    parse_number("valuenum").alias("valuenum"))
    j = window_join(l, s, ["subject_id", "hadm_id"], "charttime", "intime", "__end", max(float(hours), 1.0))
    return (j.drop("__end").withColumn("hours_from_ed", hours_between("intime", "charttime"))
             .where((F.col("hours_from_ed") >= 0) & (F.col("hours_from_ed") <= float(hours))))


def assign_lab_groups(labs: DataFrame, dim: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Item → group (and its minutes) by broadcast of the item dimension.

    The dimension holds one row per configured item (56), a size fixed by
    the constants, so the broadcast is bounded. Unmapped items are dropped,
    or kept as 'UNKNOWN' with 0 minutes.
    """
    d = F.broadcast(dim.select("itemid", "lab_group", "group_minutes"))
    if not keep_unknown:
        return labs.join(d, "itemid", "inner")
    return (labs.join(d, "itemid", "left")
                .withColumn("lab_group", F.coalesce("lab_group", F.lit("UNKNOWN")))
                .withColumn("group_minutes", F.coalesce("group_minutes", F.lit(0))))


def order_key() -> Column:
    """The order of results within a stay, (time, item), as one number."""
    micros = F.round(F.col("hours_from_ed") * F.lit(MICROS_PER_HOUR)).cast("decimal(20,0)")
    return (micros * F.lit(1 << 31).cast("decimal(10,0)") + F.col("itemid").cast("decimal(10,0)")).cast("decimal(38,0)")


def settled(labs: DataFrame, *more: str) -> DataFrame:
    """One row per (stay, group, order key, ``more``): the smallest value of
    those that share time and item. Rows without a value keep a null."""
    keyed = labs.withColumn("__key", order_key())
    return keyed.groupBy("stay_id", "lab_group", "__key", *more).agg(
        F.min("valuenum").alias("valuenum"), F.min("hours_from_ed").alias("hours_from_ed"))


def first_values_long(labs: DataFrame) -> DataFrame:
    """A1: first value and its time per (stay, lab group), by (time, item,
    value)."""
    return settled(labs.where(F.col("valuenum").isNotNull())).groupBy("stay_id", "lab_group").agg(
        F.min_by("valuenum", "__key").alias("valuenum"), F.min("hours_from_ed").alias("hours_from_ed"))


def mean_values_long(labs: DataFrame) -> DataFrame:
    """A2: mean value and earliest time per (stay, lab group)."""
    return labs.groupBy("stay_id", "lab_group").agg(
        F.avg("valuenum").alias("valuenum"), F.min("hours_from_ed").alias("hours_from_ed"))


def wide_terms(use_first: bool = True) -> list[Column]:
    """Aggregate terms of the lab pivot, over ``settled`` rows for first values
    or over the results themselves for means. Rows of other groups (or without
    a value) are ignored, so other events may share the aggregate."""
    terms = []
    for g in LAB_GROUPS:
        inside = F.col("lab_group") == g
        value = F.avg(F.when(inside, F.col("valuenum")))
        if use_first:
            inside = inside & F.col("valuenum").isNotNull()
            value = F.min_by("valuenum", F.when(inside, F.col("__key")))
        terms += [value.alias(value_col(g)), F.min(F.when(inside, F.col("hours_from_ed"))).alias(time_col(g))]
    return terms


def labs_wide(labs: DataFrame, use_first: bool = True) -> DataFrame:
    """A3: one row per stay with ``lab_<G>_value`` / ``lab_<G>_time`` for the
    fixed group list (see module note)."""
    rows = settled(labs) if use_first else labs
    return rows.groupBy("stay_id").agg(*wide_terms(use_first))


def top_groups(labs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent groups of ``labs`` and their share (%) of all
    its results (ties by name). One row holds the counts of the configured few
    groups and their total."""
    counts = labs.groupBy("lab_group").agg(F.count(F.lit(1)).alias("n_results"))
    whole = counts.agg(F.sum("n_results").alias("__total"),
                       F.collect_list(F.struct("lab_group", "n_results")).alias("__groups"))
    shares = whole.select("__total", F.inline("__groups"))
    return (shares.select("lab_group", "n_results", pct("n_results", "__total").alias("share_pct"))
            .orderBy(F.desc("n_results"), "lab_group").limit(n))


def add_utilization_flags(df: DataFrame) -> DataFrame:
    """A4: ``lab_<G>_ordered`` (value present) and their total. Absent
    values stay null (no imputation)."""
    flags = {ordered_col(g): F.col(value_col(g)).isNotNull().cast("int") for g in LAB_GROUPS
             if has(df, value_col(g))}
    df = df.withColumns(flags)
    return df.withColumn("total_lab_groups_ordered",
                         reduce(lambda a, b: a + b, [F.col(c) for c in flags]))


def add_empty_lab_features(df: DataFrame) -> DataFrame:
    """A4 variant for a run without lab data: null values and times, 0 flags."""
    new = {}
    for g in LAB_GROUPS:
        new[value_col(g)] = F.lit(None).cast("double")
        new[time_col(g)] = F.lit(None).cast("double")
        new[ordered_col(g)] = F.lit(0)
    new["total_lab_groups_ordered"] = F.lit(0)
    return df.withColumns(new)


def prepare_labs(labevents: DataFrame, stays: DataFrame, dim: DataFrame,
                 hours: float = 12.0) -> DataFrame:
    """S3 → J4 → J13: relevant, valued lab results inside each stay's window."""
    scanned = scan_labevents(labevents, strategy="filtered")
    return assign_lab_groups(labs_in_window(scanned, stays, hours), dim)


def extract_lab_features(df: DataFrame, labevents: DataFrame | None,
                         dim: DataFrame | None = None, time_window_hours: float = 12.0,
                         use_first_value: bool = True, spark: SparkSession | None = None,
                         keys: DataFrame | None = None) -> DataFrame:
    """J4 → J13 → A1/A2 → A3 → J5 → A4 on the cohort frame. ``keys``
    (stay_id, subject_id, hadm_id, intime of the same stays) is the narrow
    side of the window join; by default it is projected from ``df``."""
    check_input(df, "stays", STAY_KEYS, non_empty=False)
    if labevents is None:
        return add_empty_lab_features(df)
    dim = dim if dim is not None else lab_dim(spark or df.sparkSession)
    stays = keys if keys is not None else df.select("stay_id", "subject_id", "hadm_id", "intime")
    labs = prepare_labs(labevents, stays, dim, time_window_hours)
    wide = labs_wide(labs, use_first_value)
    return df.join(wide, "stay_id", "left").transform(add_utilization_flags)


def lab_time_costs(df: DataFrame) -> DataFrame:
    """A5: sequential (sum), parallel (max), mixed (0.7·par + 0.3·seq) minutes
    over the ordered groups; mixed in hours; share of the ED stay in %."""
    terms = [F.when(F.col(ordered_col(g)) == 1, F.lit(float(m))).otherwise(F.lit(0.0))
             for g, m in GROUP_MINUTES.items() if has(df, ordered_col(g))]
    seq = reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)
    par = F.greatest(F.lit(0.0), *terms) if terms else F.lit(0.0)
    df = df.withColumns({"lab_time_cost_sequential": seq, "lab_time_cost_parallel": par})
    df = df.withColumn("lab_time_cost_mixed",
                       F.lit(PARALLEL_WEIGHT) * F.col("lab_time_cost_parallel")
                       + F.lit(SEQUENTIAL_WEIGHT) * F.col("lab_time_cost_sequential"))
    df = df.withColumn("lab_time_cost_hours", F.col("lab_time_cost_mixed") / F.lit(60.0))
    if has(df, "ed_los_hours"):
        df = df.withColumn("lab_time_pct_of_los",
                           F.try_divide(F.col("lab_time_cost_hours"),
                                        F.when(F.col("ed_los_hours") != 0, F.col("ed_los_hours")))
                           * F.lit(100.0))
    return df


def lab_items_missing(d_labitems: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Configured items absent from the item dictionary, per group.

    The configuration (60 entries) is a fixed literal frame; the dictionary
    side is reduced to its distinct ids before the anti join.
    """
    spark = spark or d_labitems.sparkSession
    rows = [(g, pos, item) for g, items in LAB_GROUP_ITEMS.items() for pos, item in enumerate(items)]
    cfg = spark.createDataFrame(rows, "lab_group string, item_pos int, itemid int")
    missing = cfg.join(d_labitems.select(F.col("itemid").cast("int").alias("itemid")).distinct(),
                       "itemid", "left_anti")
    return missing.groupBy("lab_group").agg(
        F.count(F.lit(1)).alias("n_missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "itemid"))),
                                 lambda s: s["itemid"].cast("string")), ",").alias("missing_itemids"))
