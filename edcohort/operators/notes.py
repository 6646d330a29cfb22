"""Clinical notes: availability in time, cleaning, reports (J7, J8, J14,
F2, P16, A15, A22–A25, A26, A34).

The availability rule is a join on the admission key and time bucket
(``intervals.before_join``) with a one-sided time bound as residual. Buffer sweeps and per-category retention are one
join and one aggregate, not one join per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import pct, to_long
from ..functions.text import clean_text, keywords
from ..functions.timecols import add_hours, minutes_between, parse_timestamp
from ..sources.schemas import has
from ..sources.sinks import write_stage
from .intervals import before_join
from .quantiles import global_quantiles, quantile_frame

# --- fixed values: hybrid availability buffers (hours) per note category ---
HYBRID_BUFFERS = {"radiology": 0.0, "discharge": 12.0}
SWEEP_BUFFERS = [0, 2, 6, 12, 24]
MIN_TEXT_LENGTH = 50


def note_time_column(notes: DataFrame) -> str | None:
    """Charttime if present, else chartdate, else none (schema check)."""
    for c in ("charttime", "chartdate"):
        if has(notes, c):
            return c
    return None


def _join_stays(notes: DataFrame, stays: DataFrame, time_col: str, most_hours: float | None = None) -> DataFrame:
    """Notes with the stays of their admission: ``__t``, ``__in``, ``__out``;
    with ``most_hours`` only those up to so long after discharge, joined by
    time bucket."""
    s = (stays.select("subject_id", "hadm_id", parse_timestamp("intime").alias("__in"),
                      parse_timestamp("outtime").alias("__out"))
         .where(F.col("__in").isNotNull() & F.col("__out").isNotNull()))
    n = (notes.where(F.col("hadm_id").isNotNull()).withColumn("__t", parse_timestamp(time_col))
         .where(F.col("__t").isNotNull()))
    if most_hours is None:
        return n.join(s, ["subject_id", "hadm_id"])
    s = s.withColumn("__end", add_hours("__out", float(most_hours)))
    return before_join(n, s, ["subject_id", "hadm_id"], "__t", "__end").drop("__end")


def filter_temporal(notes: DataFrame, stays: DataFrame, time_buffer_hours: float | Column = 0.0,
                    most_hours: float | None = None) -> DataFrame:
    """Notes known by ED discharge (+ buffer): note time ≤ outtime +
    buffer, no lower bound. Adds ``time_from_admission_min``. Notes without
    a time column (or stays without hadm_id) are returned unchanged. A buffer
    given as a column needs its largest value, ``most_hours``."""
    tc = note_time_column(notes)
    if tc is None or not has(notes, "hadm_id") or not has(stays, "hadm_id"):
        return notes
    j = _join_stays(notes, stays, tc, time_buffer_hours if most_hours is None else most_hours)
    limit = add_hours("__out", time_buffer_hours)
    return (j.where(F.col("__t") <= limit)
             .withColumn("time_from_admission_min", minutes_between("__in", "__t"))
             .drop("__in", "__out", "__t"))


def filter_temporal_hybrid(notes: DataFrame, stays: DataFrame,
                           buffers: dict[str, float] | None = None) -> DataFrame:
    """Per-category buffers (radiology 0 h, discharge 12 h) in ONE pass;
    categories without a buffer are dropped, as in a union of the filtered
    categories."""
    buffers = buffers or HYBRID_BUFFERS
    b = None
    for cat, h in buffers.items():
        cond = F.col("note_category") == cat
        b = F.when(cond, F.lit(float(h))) if b is None else b.when(cond, F.lit(float(h)))
    kept = notes.where(F.col("note_category").isin(list(buffers)))
    return filter_temporal(kept, stays, b, max(buffers.values()))


def notes_for_stay(notes: DataFrame, admissions: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """All notes of the given admission(s), time-ordered. ``admissions``
    holds (subject_id, hadm_id) keys; it is a semi join, never a collect."""
    n = notes if categories is None else notes.where(F.col("note_category").isin(categories))
    n = n.join(admissions.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")
    tc = note_time_column(n)
    return n.orderBy(*([tc] if tc else []), "note_id")


def preprocess_notes(notes: DataFrame, text_column: str = "text", min_text_length: int = MIN_TEXT_LENGTH,
                     remove_special_chars: bool = False, lowercase: bool = False) -> DataFrame:
    """cleaned text, original and cleaned length, validity flag."""
    cleaned = clean_text(text_column, remove_special_chars, lowercase)
    return notes.withColumns({
        "cleaned_text": cleaned,
        "original_length": F.length(text_column),
    }).withColumn("cleaned_length", F.length("cleaned_text")) \
      .withColumn("is_valid", F.col("cleaned_length") >= min_text_length)


def valid_notes(notes: DataFrame) -> DataFrame:
    """Keep notes whose cleaned text is long enough."""
    return notes.where(F.col("is_valid"))


def notes_stats(notes: DataFrame, exact: bool = True) -> DataFrame:
    """Totals, patients, admissions, text length mean/median and date
    range, overall ('All') and per category (ROLLUP). The texts are read (and
    joined, if ``notes`` is a join) once: their lengths become a stage table that
    the aggregate and both medians read."""
    tc = note_time_column(notes)
    notes = write_stage(notes.select("subject_id", "hadm_id", "note_category", F.length("text").alias("__len"),
                                     *([tc] if tc else [])), "note_lengths")
    length = F.col("__len")
    aggs = [F.count(F.lit(1)).alias("n_notes"), F.count_distinct("subject_id").alias("n_patients"),
            F.count_distinct("hadm_id").alias("n_admissions"), F.avg(length).alias("avg_text_length"),
            F.grouping("note_category").alias("__g")]
    if tc:
        aggs += [F.min(tc).alias("earliest"), F.max(tc).alias("latest")]
    out = notes.rollup("note_category").agg(*aggs)
    out = out.withColumn("note_category", F.when(F.col("__g") == 1, F.lit("All"))
                         .otherwise(F.col("note_category"))).drop("__g")
    lens = notes.select("note_category", "__len")
    per_cat = quantile_frame(lens, "__len", [0.5], ["note_category"], exact).select(
        "note_category", F.col("q")[0].alias("__m"))
    overall = global_quantiles(lens, "__len", [0.5], exact)[0]
    return (out.join(per_cat, "note_category", "left")
               .withColumn("median_text_length",
                           (F.when(F.col("note_category") == "All", overall).otherwise(F.col("__m"))))
               .drop("__m"))


def retention_sweep(notes: DataFrame, stays: DataFrame, buffers: list[float] | None = None) -> DataFrame:
    """Notes kept for each buffer from ONE join and one aggregate
    (``count_if`` per buffer), in long form."""
    buffers = buffers or SWEEP_BUFFERS
    tc = note_time_column(notes)
    j = _join_stays(notes, stays, tc)
    agg = j.agg(F.count(F.lit(1)).alias("n_joined"),
                *[F.count_if(F.col("__t") <= add_hours("__out", float(b))).alias(f"b{i}")
                  for i, b in enumerate(buffers)])
    rows = [(float(b), F.col(f"b{i}")) for i, b in enumerate(buffers)]
    long = to_long(agg, rows, ["buffer_hours", "n_kept"], keep=["n_joined"])
    return long.select("buffer_hours", "n_kept", "n_joined",
                       pct("n_kept", "n_joined").alias("pct_kept"))


def retention_by_category(notes: DataFrame, stays: DataFrame, time_buffer_hours: float = 0.0) -> DataFrame:
    """Per category: notes in, joined rows retained (fan-out counts) and
    the rate. Both counts come from one grouped aggregate over a union."""
    tc = note_time_column(notes)
    j = _join_stays(notes, stays, tc, time_buffer_hours)
    kept = j.where(F.col("__t") <= add_hours("__out", time_buffer_hours))
    u = (notes.select("note_category", F.lit(1).alias("__in"), F.lit(0).alias("__kept"))
         .unionByName(kept.select("note_category", F.lit(0).alias("__in"), F.lit(1).alias("__kept"))))
    out = u.groupBy("note_category").agg(F.sum("__in").cast("long").alias("n_total"),
                                         F.sum("__kept").cast("long").alias("n_retained"))
    return out.withColumn("retention_pct", pct("n_retained", "n_total"))


def notes_per_outcome(notes: DataFrame, outcomes: DataFrame, outcome: str = "critical_outcome",
                      exact: bool = True) -> DataFrame:
    """A24 (with J10): notes joined to stay outcomes; per outcome the number
    of notes and admissions and the distribution of notes per admission."""
    o = outcomes.select("subject_id", "hadm_id", F.col(outcome).alias("outcome")).distinct()
    j = notes.join(o, ["subject_id", "hadm_id"], "inner")
    per_adm = j.groupBy("outcome", "subject_id", "hadm_id").agg(F.count(F.lit(1)).alias("k"))
    med = quantile_frame(per_adm, "k", [0.5], ["outcome"], exact).select(
        "outcome", F.col("q")[0].alias("median_notes_per_admission"))
    return per_adm.groupBy("outcome").agg(
        F.sum("k").cast("long").alias("n_notes"), F.count(F.lit(1)).alias("n_admissions"),
        F.avg("k").alias("mean_notes_per_admission"),
        F.min("k").alias("min_notes_per_admission"), F.max("k").alias("max_notes_per_admission")
    ).join(med, "outcome", "left")


def time_coverage(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per time column: non-null count and %, min, max (one aggregate)."""
    cols = [c for c in (cols or ["charttime", "chartdate", "storetime"]) if has(df, c)]
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[x for c in cols for x in (F.count(c).alias(f"{c}|nn"), F.min(c).alias(f"{c}|min"),
                                              F.max(c).alias(f"{c}|max"))])
    rows = [(c, F.col(f"`{c}|nn`"), F.col(f"`{c}|min`").cast("timestamp_ntz"),
             F.col(f"`{c}|max`").cast("timestamp_ntz")) for c in cols]
    long = to_long(wide, rows, ["column", "non_null", "min_time", "max_time"], keep=["__n"])
    return long.select("column", "non_null", pct("non_null", "__n").alias("pct_non_null"),
                       "min_time", "max_time")


def top_keywords(notes: DataFrame, text_column: str = "text", top: int = 30,
                 fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The ``top`` most frequent keywords over the whole corpus (a
    seeded sample only when ``fraction`` is given). Word count with
    map-side combine, then a top-k (ties broken by the word)."""
    src = notes.where(F.col(text_column).isNotNull())
    if fraction is not None:
        src = src.sample(fraction=fraction, seed=seed)
    words = src.select(F.explode(keywords(text_column)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("word")).limit(top)


def notes_sample(notes: DataFrame, n: int = 1000, seed: int = 42, order: Column | None = None) -> DataFrame:
    """T5: a reproducible sample of ``n`` notes: the ``n`` smallest values of
    a pseudo-random order key (by default the seeded hash of the note id),
    ties by note id. A top-k, so each task keeps at most ``n`` rows; the cap
    is the feature of this operator."""
    key = order if order is not None else F.xxhash64(F.col("note_id"), F.lit(seed))
    return notes.orderBy(key, "note_id").limit(n)


def text_reduction(notes: DataFrame) -> DataFrame:
    """Characters before/after cleaning, reduction ratio, valid share."""
    return notes.agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.sum("original_length").cast("long").alias("original_chars"),
        F.sum("cleaned_length").cast("long").alias("cleaned_chars"),
        (F.lit(1.0) - F.try_divide(F.sum("cleaned_length").cast("double"),
                                     F.sum("original_length").cast("double"))).alias("reduction_ratio"),
        (F.avg(F.col("is_valid").cast("double")) * 100.0).alias("valid_pct"))
