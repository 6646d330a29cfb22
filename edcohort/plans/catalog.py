"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Every query derives the clinical-shaped tables from the driver tables in
``sf_dir`` (see ``sources.fixtures``) and runs one operator or chain of the
library over them, whole tables in, no row caps. Computed doubles are rounded
to 6 places so the SQL oracle can compare values across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import r6
from ..functions.text import clean_text as _clean
from ..functions.text import segment_text
from ..functions.timecols import parse_number, temporal_features
from ..operators import cohort as C
from ..operators import fusion as FU
from ..operators import labels as LB
from ..operators import labs as LS
from ..operators import notes as NO
from ..operators import profile as PR
from ..operators import sequence as SQ
from ..operators.split import first_n, modular_order, split_validation
from ..session import ensure_checkpoint_dir
from ..operators.triage import TRIAGE_FEATURE_COLS, extract_triage_features
from ..sources.fixtures import d_labitems_from, fixture_tables, read_driver, vitalsign_from
from ..sources.labdim import relevant_itemids
from ..sources.readers import (STAY_KEYS, assemble_tables, check_input, load_notes, load_tables, sample_tables,
                               scan_labevents)
from ..sources.schemas import FEATURE_PREFIXES, NOTE_CATEGORIES, SOURCE_FILES, columns_with
from ..sources.sinks import run_manifest, write_observed, write_stage
from . import text as TX
from .tabular import featured_stays, labelled_stays

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


#: Reports whose doubles are rounded here, for comparison across engines; the
#: operators return them in full.
ROUNDED = {
    "cohort_summary", "run_stats", "label_summary", "crosstab_normalized", "label_rate_check", "feature_summary",
    "los_describe", "note_length_describe", "value_counts", "completeness", "column_metadata",
    "lab_utilization_pct", "histogram", "box_stats", "row_loss", "source_profile", "notes_stats",
    "retention_sweep", "retention_by_category", "notes_per_outcome", "time_coverage", "text_reduction",
    "integration_stats", "outcome_by_text", "split_validation", "run_manifest", "label_correlations",
    "lab_value_describe", "lab_group_distribution", "lab_value_box", "label_correlations_signed", "sequence_stats", "lab_group_frequency",
}


def query(name: str):
    def wrap(fn: QueryFn) -> QueryFn:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: r6(c) for c, kind in df.dtypes if kind == "double"})

        REGISTRY[name] = rounded if name in ROUNDED else fn
        return fn
    return wrap


COHORT_COLS = ["stay_id", "subject_id", "hadm_id", "intime", "outtime", "gender", "anchor_age",
               "anchor_year", "admittime", "dischtime", "hospital_expire_flag", "temperature",
               "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity", "pain", "chiefcomplaint",
               "age_at_ed", "triage_completeness", "ed_los_hours", "lengthened_ed_stay",
               "hospital_death", "age_group"]


@query("cohort_full")
def q_cohort_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_filters(fixture_tables(spark, sf_dir)).select(*COHORT_COLS)


@query("cohort_funnel")
def q_cohort_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cohort_funnel(fixture_tables(spark, sf_dir))


# ------------------------------------------------------------ cohort block


JOINED_COLS = COHORT_COLS[:20]
COST_COLS = ["lab_time_cost_sequential", "lab_time_cost_parallel", "lab_time_cost_mixed",
             "lab_time_cost_hours", "lab_time_pct_of_los"]
LAB_FEATURE_COLS = LS.WIDE_COLS + LS.FLAG_COLS + ["total_lab_groups_ordered"]
LABELLED_COLS = (COHORT_COLS + TRIAGE_FEATURE_COLS + LAB_FEATURE_COLS + COST_COLS
                 + ["icu_transfer_12h", "critical_outcome"])
VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]


def _cost_cols() -> list:
    return [r6(c).alias(c) for c in COST_COLS]


@query("join_stays_patients")
def q_join_stays_patients(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return C.join_patients(t.edstays, t.patients).select(*COHORT_COLS[:8])


@query("join_stays_admissions")
def q_join_stays_admissions(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return (C.join_patients(t.edstays, t.patients).transform(C.join_admissions, t.admissions)
            .select(*COHORT_COLS[:11]))


@query("join_stays_triage")
def q_join_stays_triage(spark, sf_dir):
    return C.merge_initial(fixture_tables(spark, sf_dir)).select(*JOINED_COLS)


@query("cohort_admitted")
def q_cohort_admitted(spark, sf_dir):
    return C.merge_initial(fixture_tables(spark, sf_dir)).transform(C.filter_admitted).select(*JOINED_COLS)


@query("cohort_adults")
def q_cohort_adults(spark, sf_dir):
    return (C.merge_initial(fixture_tables(spark, sf_dir)).transform(C.filter_admitted)
            .transform(C.filter_adults).select(*JOINED_COLS, "age_at_ed"))


@query("cohort_triage_complete")
def q_cohort_triage_complete(spark, sf_dir):
    return (C.merge_initial(fixture_tables(spark, sf_dir)).transform(C.filter_admitted)
            .transform(C.filter_adults).transform(C.filter_complete_triage)
            .select(*JOINED_COLS, "age_at_ed", "triage_completeness"))


@query("ed_los")
def q_ed_los(spark, sf_dir):
    return C.apply_filters(fixture_tables(spark, sf_dir)).select("stay_id", "intime", "outtime", "ed_los_hours")


@query("stay_flags")
def q_stay_flags(spark, sf_dir):
    return C.apply_filters(fixture_tables(spark, sf_dir)).select(
        "stay_id", "ed_los_hours", "lengthened_ed_stay", "hospital_expire_flag", "hospital_death")


@query("age_bands")
def q_age_bands(spark, sf_dir):
    return C.apply_filters(fixture_tables(spark, sf_dir)).select("stay_id", "age_at_ed", "age_group")


@query("pain_numeric")
def q_pain_numeric(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return t.triage.select("stay_id", "pain", parse_number("pain").alias("pain_numeric"))


@query("triage_features")
def q_triage_features(spark, sf_dir):
    return extract_triage_features(C.apply_filters(fixture_tables(spark, sf_dir))).select(
        "stay_id", *TRIAGE_FEATURE_COLS)


@query("vital_zscores")
def q_vital_zscores(spark, sf_dir):
    df = C.vital_zscores(C.apply_filters(fixture_tables(spark, sf_dir)))
    return df.select("stay_id", *[r6(f"{c}_zscore").alias(f"{c}_zscore") for c in VITALS],
                     *[f"{c}_abnormal" for c in VITALS])


@query("vital_risk_score")
def q_vital_risk_score(spark, sf_dir):
    df = C.apply_filters(fixture_tables(spark, sf_dir)).transform(C.vital_zscores).transform(C.vital_risk_score)
    return df.select("stay_id", "vital_risk_score")


@query("temporal_features")
def q_temporal_features(spark, sf_dir):
    return temporal_features(C.apply_filters(fixture_tables(spark, sf_dir))).select(
        "stay_id", "intime", "hour_of_day", "day_of_week", "is_weekend", "is_night")


@query("semi_admissions")
def q_semi_admissions(spark, sf_dir):
    """Admissions of cohort stays, by semi join (ids stay distributed)."""
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return t.admissions.join(cohort.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")


@query("distinct_ids")
def q_distinct_ids(spark, sf_dir):
    """Distinct patients of the cohort."""
    return C.apply_filters(fixture_tables(spark, sf_dir)).select("subject_id").distinct()


@query("cohort_summary")
def q_cohort_summary(spark, sf_dir):
    from ..operators.profile import cohort_summary
    return cohort_summary(C.apply_filters(fixture_tables(spark, sf_dir)))


# -------------------------------------------------------------- labs block

@query("lab_scan_filtered")
def q_lab_scan_filtered(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return scan_labevents(t.labevents, patients=t.patients, strategy="filtered")


@query("lab_scan_full")
def q_lab_scan_full(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return scan_labevents(t.labevents, patients=t.patients, strategy="full")


@query("lab_scan_sample")
def q_lab_scan_sample(spark, sf_dir):
    """The sampling strategy, 20,000 rows in key order."""
    t = fixture_tables(spark, sf_dir)
    return scan_labevents(t.labevents, patients=t.patients, strategy="sample", max_rows=20_000)


@query("labs_first_half")
def q_labs_first_half(spark, sf_dir):
    """T4: the first half of all lab events with a value, by the distributed cut."""
    labs = scan_labevents(fixture_tables(spark, sf_dir).labevents, strategy="full")
    order = ["subject_id", "hadm_id", "charttime", "itemid", "valuenum"]
    return first_n(labs, labs.count() // 2, order, one_task_rows=0)


def _labs(spark, sf_dir, hours=12.0):
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return LS.prepare_labs(t.labevents, cohort, t.extra["lab_dim"], hours)


@query("labs_in_window")
def q_labs_in_window(spark, sf_dir):
    return _labs(spark, sf_dir).select("stay_id", "subject_id", "hadm_id", "itemid", "charttime",
                                       "valuenum", "hours_from_ed")


@query("lab_group_lookup")
def q_lab_group_lookup(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    dim = t.extra["lab_dim"]
    g = LS.assign_lab_groups(t.labevents, dim, keep_unknown=True)
    return g.groupBy("itemid", "lab_group", "group_minutes").agg(F.count(F.lit(1)).alias("n_results"))


@query("labs_first_value")
def q_labs_first_value(spark, sf_dir):
    return LS.first_values_long(_labs(spark, sf_dir))


@query("labs_mean_value")
def q_labs_mean_value(spark, sf_dir):
    df = LS.mean_values_long(_labs(spark, sf_dir))
    return df.select("stay_id", "lab_group", r6("valuenum").alias("valuenum"), "hours_from_ed")


@query("labs_wide")
def q_labs_wide(spark, sf_dir):
    return LS.labs_wide(_labs(spark, sf_dir))


@query("lab_utilization")
def q_lab_utilization(spark, sf_dir):
    return featured_stays(fixture_tables(spark, sf_dir)).select(
        "stay_id", *LS.FLAG_COLS, "total_lab_groups_ordered")


@query("lab_features")
def q_lab_features(spark, sf_dir):
    return featured_stays(fixture_tables(spark, sf_dir)).select("stay_id", *LAB_FEATURE_COLS)


@query("lab_time_costs")
def q_lab_time_costs(spark, sf_dir):
    return featured_stays(fixture_tables(spark, sf_dir)).select("stay_id", "ed_los_hours", *_cost_cols())


@query("lab_items_missing")
def q_lab_items_missing(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return LS.lab_items_missing(d_labitems_from(read_driver(spark, sf_dir, "part"), t.extra["lab_dim"]))


# ------------------------------------------------------------ labels block

def _labelled(spark, sf_dir):
    return labelled_stays(fixture_tables(spark, sf_dir))


@query("hospital_death")
def q_hospital_death(spark, sf_dir):
    return LB.hospital_death(C.apply_filters(fixture_tables(spark, sf_dir))).select("stay_id", "hospital_death")


@query("icu_transfer_12h")
def q_icu_transfer(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return LB.icu_transfer(C.apply_filters(t), t.icustays).select("stay_id", "outtime", "icu_transfer_12h")


@query("critical_outcome")
def q_critical_outcome(spark, sf_dir):
    return _labelled(spark, sf_dir).select("stay_id", "hospital_death", "icu_transfer_12h", "critical_outcome")


@query("lengthened_ed_stay")
def q_lengthened_ed_stay(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    # O4 on stays without the clamped LOS column: raw LOS fallback
    df = C.merge_initial(t).transform(C.filter_admitted)
    return LB.lengthened_stay(df).select("stay_id", "lengthened_ed_stay")


@query("all_labels")
def q_all_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("stay_id", *LB.LABEL_COLS)


@query("labelled_stays")
def q_labelled_stays(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.select(*[r6(c).alias(c) if c in COST_COLS else F.col(c) for c in LABELLED_COLS])


@query("label_summary")
def q_label_summary(spark, sf_dir):
    return LB.label_summary(_labelled(spark, sf_dir))


@query("label_overlap")
def q_label_overlap(spark, sf_dir):
    return LB.label_overlap(_labelled(spark, sf_dir))


@query("crosstab_margins")
def q_crosstab_margins(spark, sf_dir):
    return LB.crosstab_margins(_labelled(spark, sf_dir))


@query("crosstab_normalized")
def q_crosstab_normalized(spark, sf_dir):
    return LB.crosstab_normalized(_labelled(spark, sf_dir))


@query("label_rate_check")
def q_label_rate_check(spark, sf_dir):
    return LB.label_rate_check(_labelled(spark, sf_dir))


#: The numeric columns of the labelled stays (P18 finds them in the schema).
CORR_FEATURES = (["anchor_age", "anchor_year", "hospital_expire_flag", "temperature", "heartrate", "resprate",
                  "o2sat", "sbp", "dbp", "acuity", "age_at_ed", "triage_completeness", "ed_los_hours"]
                 + [c for c in TRIAGE_FEATURE_COLS if c != "triage_chief_complaint"]
                 + LAB_FEATURE_COLS + COST_COLS)


@query("label_correlations")
def q_label_correlations(spark, sf_dir):
    """A12 with P18: the features are the numeric columns of the schema."""
    return LB.label_correlations(_labelled(spark, sf_dir))


@query("run_stats")
def q_run_stats(spark, sf_dir):
    from ..operators.profile import run_stats
    return run_stats(_labelled(spark, sf_dir))


# -------------------------------------------------------------- text block

NOTE_COLS = ["note_id", "subject_id", "hadm_id", "note_type", "note_category", "category_priority",
             "charttime", "text"]


def _notes(spark, sf_dir):
    return TX.non_empty_notes(fixture_tables(spark, sf_dir).notes)


def _prepared(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return TX.prepared_notes(t.notes, C.apply_filters(t), only_valid=False)


def _multimodal(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return TX.multimodal(labelled_stays(t, cohort=cohort), cohort, t)


def _split(spark, sf_dir):
    """The split of a stage table, as in ``runner.run_all``: its counts and cut
    buckets read the table, not the plan behind it."""
    staged = write_stage(_multimodal(spark, sf_dir), "multimodal", spark)
    return TX.split_multimodal(staged, order=modular_order())


@query("notes_load")
def q_notes_load(spark, sf_dir):
    return _notes(spark, sf_dir).select(*NOTE_COLS)


@query("notes_temporal")
def q_notes_temporal(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return NO.filter_temporal(TX.non_empty_notes(t.notes), t.edstays, 0.0).select(
        "note_id", "subject_id", "hadm_id", "note_category", "charttime", r6("time_from_admission_min")
        .alias("time_from_admission_min"))


@query("notes_temporal_hybrid")
def q_notes_temporal_hybrid(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return TX.available_notes(t.notes, t.edstays).select(
        "note_id", "subject_id", "hadm_id", "note_category", "charttime",
        r6("time_from_admission_min").alias("time_from_admission_min"))


@query("notes_for_stay")
def q_notes_for_stay(spark, sf_dir):
    """J14 for the admission with the most notes (ties: smallest id)."""
    notes = _notes(spark, sf_dir)
    busiest = (notes.where(F.col("hadm_id").isNotNull()).groupBy("subject_id", "hadm_id")
               .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "hadm_id").limit(1))
    return NO.notes_for_stay(notes, busiest).select("note_id", "subject_id", "hadm_id", "note_category",
                                                   "charttime", F.length("text").alias("text_length"))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    n = fixture_tables(spark, sf_dir).notes
    return n.select("note_id", _clean("text").alias("cleaned_text"),
                    _clean("text", remove_special_chars=True, lowercase=True).alias("cleaned_strict"))


@query("clean_notes")
def q_clean_notes(spark, sf_dir):
    n = NO.preprocess_notes(fixture_tables(spark, sf_dir).notes)
    return n.select("note_id", "original_length", "cleaned_length", "is_valid")


@query("notes_valid")
def q_notes_valid(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return TX.prepared_notes(t.notes, C.apply_filters(t)).select("note_id", "subject_id", "hadm_id", "note_category",
                                           "cleaned_length")


@query("segment_text")
def q_segment_text(spark, sf_dir):
    n = NO.preprocess_notes(_notes(spark, sf_dir))
    seg = n.select("note_id", F.posexplode(segment_text("cleaned_text")).alias("seg_no", "segment"))
    return seg.select("note_id", "seg_no", F.length("segment").alias("seg_length"), "segment")


@query("top_keywords")
def q_top_keywords(spark, sf_dir):
    return NO.top_keywords(_notes(spark, sf_dir))


@query("notes_stats")
def q_notes_stats(spark, sf_dir):
    return NO.notes_stats(_notes(spark, sf_dir))


@query("time_coverage")
def q_time_coverage(spark, sf_dir):
    return NO.time_coverage(_notes(spark, sf_dir))


@query("retention_sweep")
def q_retention_sweep(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return NO.retention_sweep(TX.non_empty_notes(t.notes), t.edstays)


@query("retention_by_category")
def q_retention_by_category(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return NO.retention_by_category(TX.non_empty_notes(t.notes), t.edstays)


@query("notes_per_outcome")
def q_notes_per_outcome(spark, sf_dir):
    return NO.notes_per_outcome(_notes(spark, sf_dir), _labelled(spark, sf_dir))


@query("text_reduction")
def q_text_reduction(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return NO.text_reduction(NO.preprocess_notes(TX.available_notes(t.notes, C.apply_filters(t))))


@query("note_priority")
def q_note_priority(spark, sf_dir):
    return FU.note_by_priority(_prepared(spark, sf_dir))


@query("note_first")
def q_note_first(spark, sf_dir):
    return FU.note_first(_prepared(spark, sf_dir))


@query("note_last")
def q_note_last(spark, sf_dir):
    return FU.note_last(_prepared(spark, sf_dir))


@query("note_concat")
def q_note_concat(spark, sf_dir):
    return FU.note_concat(_prepared(spark, sf_dir))


@query("stays_with_notes")
def q_stays_with_notes(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return FU.associate_notes_to_stays(cohort, TX.prepared_notes(t.notes, cohort, only_valid=False)).select(
        "stay_id", "subject_id", "hadm_id", "cleaned_text", "note_type")


MM_COLS = ["subject_id", "hadm_id", "stay_id", "cleaned_text", "outcome", "lengthened_ed_stay",
           "has_text"]


@query("multimodal_dataset")
def q_multimodal_dataset(spark, sf_dir):
    mm = _multimodal(spark, sf_dir)
    feats = columns_with(mm, *FEATURE_PREFIXES)
    return mm.select(*MM_COLS, *[r6(c).alias(c) if c in COST_COLS else F.col(c) for c in feats])


@query("integration_stats")
def q_integration_stats(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return FU.integration_stats(FU.associate_notes_to_stays(labelled_stays(t, cohort=cohort),
                                                            TX.prepared_notes(t.notes, cohort, only_valid=False)))


@query("outcome_by_text")
def q_outcome_by_text(spark, sf_dir):
    return FU.outcome_by_text(_multimodal(spark, sf_dir))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("stay_id", "outcome", "has_text", "split")


@query("split_validation")
def q_split_validation(spark, sf_dir):
    return split_validation(_split(spark, sf_dir))


def _examples(spark, sf_dir):
    return SQ.training_examples(_split(spark, sf_dir))


def _joined_arrays(df):
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
                       if c in ("lab_groups", "time_costs", "eos_positions", "lab_group_labels") else F.col(c)
                       for c in df.columns])


@query("linearize_triage")
def q_linearize_triage(spark, sf_dir):
    mm = _multimodal(spark, sf_dir)
    return mm.select("stay_id", SQ.linearize_triage(mm).alias("triage_text"))


@query("performed_groups")
def q_performed_groups(spark, sf_dir):
    mm = _multimodal(spark, sf_dir)
    p = SQ.performed_groups(mm)
    return mm.select("stay_id", F.array_join(F.transform(p, lambda x: x["group"]), ",").alias("groups"),
                     F.array_join(F.transform(p, lambda x: F.coalesce(x["time"].cast("string"), F.lit("-"))),
                                  ",").alias("times"))


@query("linearize_sequence")
def q_linearize_sequence(spark, sf_dir):
    seq = SQ.linearize_sequence(_multimodal(spark, sf_dir))
    return _joined_arrays(seq.select("stay_id", "text_sequence", "lab_groups", "time_costs", "eos_positions",
                                     "total_time_cost", "num_labs"))


@query("training_examples")
def q_training_examples(spark, sf_dir):
    return _joined_arrays(_examples(spark, sf_dir))


@query("lab_label_vector")
def q_lab_label_vector(spark, sf_dir):
    ex = SQ.lab_label_vector(_examples(spark, sf_dir))
    return _joined_arrays(ex.select("stay_id", "lab_group_labels", "num_labs"))


@query("lab_group_frequency")
def q_lab_group_frequency(spark, sf_dir):
    return SQ.lab_group_frequency(_examples(spark, sf_dir))


@query("sequence_stats")
def q_sequence_stats(spark, sf_dir):
    return SQ.sequence_stats(_examples(spark, sf_dir))


@query("linearize_dict_value")
def q_linearize_dict_value(spark, sf_dir):
    """F14 on a real serialized-dict column: event properties rendered as a
    lab-group style segment."""
    ev = read_driver(spark, sf_dir, "events")
    item = F.struct(F.col("event_type").alias("group"), F.col("props").alias("value"))
    return ev.select("event_id", SQ.lab_group_text(item).alias("segment_text"))


# ----------------------------------------------------------- profile block

FEATURE_SUMMARY_COLS = ([c for c in TRIAGE_FEATURE_COLS if c != "triage_chief_complaint"]
                        + [c for c in LS.WIDE_COLS if c.endswith("_value")])
COMPLETENESS_COLS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity", "pain",
                     "chiefcomplaint", "gender", "anchor_age", "ed_los_hours"]
EXPECTED_ABSENT = ["anchor_year_group", "dod", "deathtime"]
MANIFEST_CONFIG = {"strategy": "priority", "buffers": {"radiology": 0, "discharge": 12},
                   "min_text_length": 50, "ratios": [0.8, 0.1, 0.1], "order": "modular 7919 % 10007",
                   "lab_window_hours": 12}


def _fixture_dict(t):
    return {k: v for k, v in t.items() if k in ("edstays", "patients", "triage", "admissions", "icustays",
                                                  "labevents", "notes")}


@query("feature_summary")
def q_feature_summary(spark, sf_dir):
    return PR.feature_summary(_labelled(spark, sf_dir), FEATURE_SUMMARY_COLS)


@query("los_describe")
def q_los_describe(spark, sf_dir):
    return PR.describe(_labelled(spark, sf_dir), ["ed_los_hours"], bounded=True)  # whole seconds


@query("lab_value_describe")
def q_lab_value_describe(spark, sf_dir):
    """A14 over values of any domain: results in the window, per lab group."""
    return PR.describe(_labs(spark, sf_dir), ["valuenum"], by="lab_group")


@query("lab_value_box")
def q_lab_value_box(spark, sf_dir):
    """A32 over values of any domain."""
    return PR.box_stats(_labs(spark, sf_dir), "valuenum", "lab_group")


@query("note_length_describe")
def q_note_length_describe(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    notes = NO.preprocess_notes(TX.available_notes(t.notes, C.apply_filters(t)))
    # every quantile reads the lengths again, not the texts
    notes = write_stage(notes.select("note_category", "cleaned_length", "original_length"), "note_lengths", spark)
    return PR.describe(notes, ["cleaned_length", "original_length"], by="note_category", bounded=True)


@query("table_inventory")
def q_table_inventory(spark, sf_dir):
    return PR.table_inventory(_fixture_dict(fixture_tables(spark, sf_dir)))


@query("value_counts")
def q_value_counts(spark, sf_dir):
    return PR.value_counts(C.apply_filters(fixture_tables(spark, sf_dir)), "age_group", normalize=True)


@query("outcome_means")
def q_outcome_means(spark, sf_dir):
    """Means by outcome (age, LOS, lab groups)."""
    df = _labelled(spark, sf_dir)
    return df.groupBy("critical_outcome").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("age_at_ed")).alias("age_mean"),
        r6(F.avg("ed_los_hours")).alias("los_mean"),
        r6(F.avg("total_lab_groups_ordered")).alias("lab_groups_mean"))


@query("completeness")
def q_completeness(spark, sf_dir):
    return PR.completeness(C.apply_filters(fixture_tables(spark, sf_dir)), COMPLETENESS_COLS, EXPECTED_ABSENT)


@query("column_metadata")
def q_column_metadata(spark, sf_dir):
    return PR.column_metadata(C.apply_filters(fixture_tables(spark, sf_dir)), COHORT_COLS)


@query("lab_utilization_pct")
def q_lab_utilization_pct(spark, sf_dir):
    from ..sources.labdim import LAB_GROUPS
    return PR.lab_utilization_pct(_labelled(spark, sf_dir), LAB_GROUPS)


@query("histogram")
def q_histogram(spark, sf_dir):
    """A31 with the P20 display filter (LOS ≤ 100 h)."""
    df = _labelled(spark, sf_dir).where(F.col("ed_los_hours") <= 100)
    return PR.histogram(df, "ed_los_hours", 50)


@query("box_stats")
def q_box_stats(spark, sf_dir):
    return PR.box_stats(_labelled(spark, sf_dir), "ed_los_hours", "critical_outcome", bounded=True)


@query("row_loss")
def q_row_loss(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    n_rows = [F.count(F.lit(1)).alias("n")]
    cohort, in_cohort = write_observed(C.apply_filters(t), "cohort", n_rows)
    _, in_labelled = write_observed(labelled_stays(t, cohort=cohort).select("stay_id"), "labelled_ids", n_rows)
    return PR.observed_row_loss(spark, [("stays", t.edstays.count()), ("joined", C.merge_initial(t).count()),
                                        ("cohort", in_cohort["n"]), ("labelled", in_labelled["n"])])


@query("source_profile")
def q_source_profile(spark, sf_dir):
    n = fixture_tables(spark, sf_dir).notes
    srcs = {c: n.where(F.col("note_category") == c).drop("note_category") for c in ("discharge", "radiology")}
    return PR.source_profile(srcs)


@query("sampled_tables")
def q_sampled_tables(spark, sf_dir):
    """The first 500 stays in key order with their dependent rows."""
    s = sample_tables(fixture_tables(spark, sf_dir), 500)
    return PR.table_inventory({k: v for k, v in s.items() if k in ("edstays", "patients", "triage",
                                                                   "admissions", "icustays")})


@query("run_manifest")
def q_run_manifest(spark, sf_dir):
    return run_manifest(_split(spark, sf_dir), MANIFEST_CONFIG)


# ------------------------------------------------------------- loader / T5


@query("load_table_counts")
def q_load_table_counts(spark, sf_dir):
    """The table set as the loader assembles it (filtered lab strategy,
    labs of loaded patients), reported as rows and columns per table."""
    t = assemble_tables(fixture_tables(spark, sf_dir), lab_strategy="filtered")
    return PR.table_inventory(_fixture_dict(t))


def _scratch(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _outside_stays(t):
    """Patients without an ED stay, each with an admission, a diagnosis and a
    lab result, which the loader must leave out."""
    shift, when = F.lit(10_000_000_000), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    p = t.patients.select((F.col("subject_id") + shift).alias("subject_id"), "gender", "anchor_age", "anchor_year")
    adm = p.select("subject_id", F.col("subject_id").alias("hadm_id"), when.alias("admittime"),
                   when.alias("dischtime"), F.lit(0).alias("hospital_expire_flag"))
    labs = adm.select("subject_id", "hadm_id", F.lit(relevant_itemids()[0]).alias("itemid"),
                      when.alias("charttime"), F.lit(1.0).alias("valuenum"))
    return p, adm, labs


@query("load_tables_files")
def q_load_tables_files(spark, sf_dir):
    """The tables as CSV files, with patients outside any ED stay
    among them, read back by the loader."""
    t = fixture_tables(spark, sf_dir)
    p, adm, labs = _outside_stays(t)
    icd = [a.select("subject_id", "hadm_id", F.lit("I10").alias("icd_code"), F.lit(10).alias("icd_version"))
           for a in (t.admissions, adm)]
    root = _scratch(spark, "load-tables")
    files = {"edstays": t.edstays, "patients": t.patients.unionByName(p), "triage": t.triage,
             "admissions": t.admissions.unionByName(adm), "labevents": t.labevents.unionByName(labs),
             "icustays": t.icustays.withColumnRenamed("icu_stay_id", "stay_id"),
             "diagnoses_icd": icd[0].unionByName(icd[1])}
    for name, df in files.items():
        df.write.option("header", True).csv(f"{root}/{SOURCE_FILES[name]}.csv")
    loaded = load_tables(spark, root)
    return PR.table_inventory({k: v for k, v in loaded.items() if k in files}).select("table", "n_rows")


#: Stays of the loader's sample (S14) below.
SAMPLE_STAYS = 2000


@query("load_vitals_files")
def q_load_vitals_files(spark, sf_dir):
    """S4 in the loader: the vital signs of a sample of stays, from CSV."""
    t = fixture_tables(spark, sf_dir)
    root = _scratch(spark, "load-vitals")
    vitals = vitalsign_from(read_driver(spark, sf_dir, "events"), t.edstays)
    for name, df in {"edstays": t.edstays, "patients": t.patients, "vitalsign": vitals}.items():
        df.write.option("header", True).csv(f"{root}/{SOURCE_FILES[name]}.csv")
    loaded = load_tables(spark, root, load_labs=False, sample_stays=SAMPLE_STAYS).vitalsign
    # the loader decides the columns: one that does not belong would show as a tenth
    return loaded.groupBy("rhythm").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stay_id").alias("n_stays"),
        F.date_trunc("second", F.min("charttime")).cast("timestamp_ntz").alias("first"),  # CSV text holds milliseconds
        F.count_if(F.col("pain") == "unable").alias("n_unable"), F.lit(len(loaded.columns)).alias("n_columns"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")])


@query("labels_from_stage")
def q_labels_from_stage(spark, sf_dir):
    """Features and labels by their own operators from a checked stage
    table of the cohort."""
    t = fixture_tables(spark, sf_dir)
    cohort = check_input(write_stage(C.apply_filters(t), "cohort", spark), "cohort", STAY_KEYS)
    return LB.create_all_labels(featured_stays(t, cohort=cohort), t.icustays).select(
        "stay_id", "hospital_death", "icu_transfer_12h", "critical_outcome", "lengthened_ed_stay")


@query("lab_group_distribution")
def q_lab_group_distribution(spark, sf_dir):
    """The five most frequent lab groups and their share of all results."""
    return LS.top_groups(_labs(spark, sf_dir))


@query("load_notes_files")
def q_load_notes_files(spark, sf_dir):
    """Note files (quoted multi-line CSV) of admitted patients."""
    t = fixture_tables(spark, sf_dir)
    root = _scratch(spark, "load-notes")
    for name, spec in NOTE_CATEGORIES.items():
        own = t.notes.where(F.col("note_category") == name).select(
            "note_id", "subject_id", "hadm_id", "note_type", "charttime", "text")
        (own.write.option("header", True).option("quoteAll", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{root}/{spec['file']}.csv"))
    notes = load_notes(spark, root, subjects=t.patients, admissions=t.admissions)
    return notes.groupBy("note_category", "category_priority").agg(
        F.count(F.lit(1)).alias("n_notes"), F.sum(F.char_length("text")).alias("n_chars"),
        F.count_distinct("hadm_id").alias("n_admissions"))


@query("text_by_category")
def q_text_by_category(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    cohort = C.apply_filters(t)
    return FU.text_by_category(FU.associate_notes_to_stays(
        labelled_stays(t, cohort=cohort), TX.prepared_notes(t.notes, cohort, only_valid=False)))


@query("label_correlations_signed")
def q_label_correlations_signed(spark, sf_dir):
    """The top 20 by signed value."""
    return LB.label_correlations(_labelled(spark, sf_dir), top=20, signed=True)


@query("notes_sample")
def q_notes_sample(spark, sf_dir):
    """T5: 1000 notes in an arithmetic pseudo-random order that SQL engines
    share ((id · 7919) mod 10007, then id)."""
    order = F.pmod(F.col("note_id").cast("long") * 7919, F.lit(10007))
    return NO.notes_sample(_notes(spark, sf_dir), order=order).select(
        "note_id", "note_category", F.length("text").alias("text_length"))
