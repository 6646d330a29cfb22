"""Tabular plan: scan → cohort → triage → labs → costs → labels → sink.

One lazy plan from the scans to the write. Shuffles at scale: the three
cohort joins (AQE may turn the small dimension sides into broadcasts at run
time from measured sizes), one join of all stay events (lab results and ICU
admissions) on the admission key and time bucket, and one aggregate keyed by
stay that is both the lab pivot and the ICU existence test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import add_hours, hours_between, parse_number, parse_timestamp
from ..operators.cohort import apply_filters
from ..operators.intervals import window_join
from ..operators.labels import create_all_labels, critical_outcome, hospital_death, lengthened_stay
from ..operators.labs import add_utilization_flags, extract_lab_features, lab_time_costs, settled, wide_terms
from ..operators.triage import extract_triage_features
from ..sources.labdim import lab_dim
from ..sources.readers import Tables, scan_labevents


KEY_COLS = ["stay_id", "subject_id", "hadm_id", "intime", "outtime"]


def cohort_keys(cohort: DataFrame) -> DataFrame:
    """The narrow side of the lab, ICU and note joins: only the keys and the
    two anchor times of each cohort stay."""
    return cohort.select(*KEY_COLS)


def featured_stays(t: Tables, time_window_hours: float = 12.0, use_first_value: bool = True,
                   cohort: DataFrame | None = None) -> DataFrame:
    cohort = cohort if cohort is not None else apply_filters(t)
    feats = extract_triage_features(cohort)
    dim = t.extra.get("lab_dim")
    labs = extract_lab_features(feats, t.labevents, dim, time_window_hours, use_first_value,
                                keys=cohort_keys(cohort))
    return lab_time_costs(labs)


def stay_events(keys: DataFrame, labevents: DataFrame, icustays: DataFrame, dim: DataFrame,
                lab_hours: float = 12.0, icu_hours: float = 12.0, use_first_value: bool = True) -> DataFrame:
    """Lab features and the ICU flag of each stay from ONE join: lab results
    and ICU admissions are unioned into one event frame and meet the two windows
    of each stay (labs: 0–``lab_hours`` h after arrival; ICU: 0–``icu_hours`` h
    after leaving the ED) by admission key, kind and time bucket; ties among
    results are settled, then one aggregate per stay holds the lab pivot terms
    plus an ICU hit term. Equal to running J4–A3 and J6 apart."""
    k = keys.select("stay_id", "subject_id", "hadm_id", parse_timestamp("intime").alias("__in"),
                    parse_timestamp("outtime").alias("__out"))
    labs = scan_labevents(labevents, strategy="filtered").select(
        "subject_id", "hadm_id", F.col("itemid").cast("int").alias("itemid"),
        parse_timestamp("charttime").alias("__t"), parse_number("valuenum").alias("valuenum"),
        F.lit(False).alias("__icu"))
    icu = icustays.select("subject_id", "hadm_id", F.lit(None).cast("int").alias("itemid"),
                          parse_timestamp("intime").alias("__t"), F.lit(None).cast("double").alias("valuenum"),
                          F.lit(True).alias("__icu"))
    windows = [F.struct(F.lit(icu_kind).alias("__icu"), F.col(start).alias("__from"),
                        add_hours(start, float(hours)).alias("__to"))
               for icu_kind, start, hours in ((False, "__in", lab_hours), (True, "__out", icu_hours))]
    spans = k.select("stay_id", "subject_id", "hadm_id", F.inline(F.array(*windows)))
    ev = window_join(labs.unionByName(icu), spans, ["subject_id", "hadm_id", "__icu"], "__t", "__from", "__to",
                     max(float(lab_hours), float(icu_hours), 1.0))
    h = hours_between("__from", "__t")
    most = F.when(F.col("__icu"), float(icu_hours)).otherwise(float(lab_hours))
    ev = ev.where((h >= 0) & (h <= most)).withColumn("hours_from_ed", F.when(~F.col("__icu"), h))
    ev = ev.join(F.broadcast(dim.select("itemid", "lab_group")), "itemid", "left")
    if use_first_value:
        ev = settled(ev, "__icu")
    return ev.groupBy("stay_id").agg(*wide_terms(use_first_value),
                                     F.max(F.col("__icu").cast("int")).alias("__icu_hit"))


def labelled_stays(t: Tables, time_window_hours: float = 12.0, use_first_value: bool = True,
                   icu_window_hours: float = 12.0, cohort: DataFrame | None = None) -> DataFrame:
    """The labelled stay table (features + four labels), one row per stay.
    Lab features and the ICU flag come from one event join on the narrow
    cohort keys (``stay_events``), never from the wide featured frame."""
    cohort = cohort if cohort is not None else apply_filters(t)
    if t.labevents is None or t.icustays is None:
        feats = featured_stays(t, time_window_hours, use_first_value, cohort)
        return create_all_labels(feats, t.icustays, icu_window_hours, keys=cohort_keys(cohort))
    dim = t.extra.get("lab_dim")
    dim = dim if dim is not None else lab_dim(cohort.sparkSession)
    events = stay_events(cohort_keys(cohort), t.labevents, t.icustays, dim, time_window_hours,
                         icu_window_hours, use_first_value)
    feats = (extract_triage_features(cohort).join(events, "stay_id", "left")
             .transform(add_utilization_flags).transform(lab_time_costs))
    out = feats.transform(hospital_death) \
               .withColumn("icu_transfer_12h", F.coalesce(F.col("__icu_hit"), F.lit(0))).drop("__icu_hit")
    return out.transform(critical_outcome).transform(lengthened_stay)
