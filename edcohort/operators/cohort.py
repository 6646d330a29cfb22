"""Cohort building: the stay-level join and the study filters (J1–J3, P1–P10,
W6, W7, F9).

Each function is DataFrame → DataFrame and usable with ``.transform``.
Column-presence rules are schema checks made on the driver; they never start
a job. The attrition funnel is one aggregate with cumulative ``count_if``
terms instead of a count after every step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import to_long
from ..functions.timecols import hours_between, parse_timestamp
from ..sources.readers import Tables
from ..sources.schemas import has

PATIENT_COLS = ["subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"]
ADMISSION_COLS = ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime",
                  "hospital_expire_flag", "admission_type", "admission_location",
                  "discharge_location"]
# --- fixed values: triage fields of the completeness rule, and its minimum ---
TRIAGE_FIELDS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity"]
MIN_TRIAGE_FIELDS = 5
TIMESTAMP_COLS = ["intime", "outtime", "admittime", "dischtime", "deathtime"]
VITAL_COLS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]
# --- fixed values: age bands, right-closed ---
AGE_BANDS = [(0, 30, "18-30"), (30, 60, "31-60"), (60, 90, "61-90"), (90, 120, "90+")]
MAX_LOS_HOURS = 168.0
LONG_STAY_HOURS = 24.0


def available_columns(df: DataFrame, desired: list[str]) -> list[str]:
    """The desired columns the frame actually has, in desired order."""
    present = set(df.columns)
    return [c for c in desired if c in present]


def left_join_suffixed(left: DataFrame, right: DataFrame, keys: list[str],
                       suffix: str) -> DataFrame:
    """Left equi join; right-side non-key names that collide get ``suffix``."""
    clash = set(left.columns) - set(keys)
    renamed = right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c)
                             for c in right.columns])
    return left.join(renamed, keys, "left")


def join_patients(stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays ⟕ patients on subject_id; no gender column → 'U'."""
    cols = available_columns(patients, PATIENT_COLS)
    if "subject_id" not in cols:
        raise ValueError("patients has no subject_id")
    out = left_join_suffixed(stays, patients.select(*cols), ["subject_id"], "_pat")
    if "gender" not in out.columns:
        out = out.withColumn("gender", F.lit("U"))
    return out


def join_admissions(df: DataFrame, admissions: DataFrame | None) -> DataFrame:
    """⟕ admissions on (subject_id, hadm_id), colliding names get ``_adm``."""
    if admissions is None:
        return df
    cols = available_columns(admissions, ADMISSION_COLS)
    if not {"subject_id", "hadm_id"} <= set(cols):
        return df
    return left_join_suffixed(df, admissions.select(*cols), ["subject_id", "hadm_id"], "_adm")


def join_triage(df: DataFrame, triage: DataFrame | None) -> DataFrame:
    """⟕ triage on stay_id, colliding names get ``_triage``."""
    if triage is None or not has(triage, "stay_id") or not has(df, "stay_id"):
        return df
    return left_join_suffixed(df, triage, ["stay_id"], "_triage")


def merge_initial(t: Tables) -> DataFrame:
    """J1 → J2 → J3: one row per ED stay with patient, admission and triage."""
    if t.edstays is None or t.patients is None:
        raise ValueError("edstays and patients are required")
    return (t.edstays.transform(join_patients, t.patients)
            .transform(join_admissions, t.admissions)
            .transform(join_triage, t.triage))


def admitted_condition(df: DataFrame) -> Column:
    return F.col("hadm_id").isNotNull() if has(df, "hadm_id") else F.lit(True)


def filter_admitted(df: DataFrame) -> DataFrame:
    """Keep stays that led to a hospital admission."""
    return df.where(admitted_condition(df))


def with_age_at_ed(df: DataFrame) -> DataFrame:
    """Age at the visit = anchor_age + (year(intime) - anchor_year); without
    anchor_year (or intime) the anchor age is used as is."""
    if not has(df, "anchor_age"):
        return df
    if has(df, "anchor_year", "intime"):
        age = F.col("anchor_age") + (F.year(parse_timestamp(F.col("intime")))
                                     - F.col("anchor_year").try_cast("int"))
    else:
        age = F.col("anchor_age")
    return df.withColumn("age_at_ed", age.cast("int"))


def adult_condition(df: DataFrame) -> Column:
    if not has(df, "age_at_ed"):
        return F.lit(True)
    return F.coalesce(F.col("age_at_ed").between(18, 120), F.lit(False))


def filter_adults(df: DataFrame) -> DataFrame:
    """Keep 18 ≤ age ≤ 120; a null age is dropped."""
    df = with_age_at_ed(df)
    return df.where(adult_condition(df))


def with_triage_completeness(df: DataFrame) -> DataFrame:
    fields = available_columns(df, TRIAGE_FIELDS)
    if not fields:
        return df
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in fields])
    return df.withColumn("triage_completeness", n)


def triage_condition(df: DataFrame) -> Column:
    fields = available_columns(df, TRIAGE_FIELDS)
    if not fields or not has(df, "triage_completeness"):
        return F.lit(True)
    return F.col("triage_completeness") >= min(MIN_TRIAGE_FIELDS, len(fields))


def filter_complete_triage(df: DataFrame) -> DataFrame:
    """Keep stays with at least min(5, fields present) of the 7 triage fields."""
    df = with_triage_completeness(df)
    return df.where(triage_condition(df))


def process_timestamps(df: DataFrame) -> DataFrame:
    """P5: timestamp columns parsed; unparsable values become null."""
    return df.withColumns({c: parse_timestamp(F.col(c)) for c in available_columns(df, TIMESTAMP_COLS)})


def with_ed_los(df: DataFrame) -> DataFrame:
    """ED length of stay in hours; negative or over 168 h → null."""
    if not has(df, "intime", "outtime"):
        return df
    los = hours_between("intime", "outtime")
    return df.withColumn("ed_los_hours",
                         F.when((los >= 0) & (los <= MAX_LOS_HOURS), los))


def age_band(age: Column) -> Column:
    """Right-closed bands (0,30] (30,60] (60,90] (90,120]; else null."""
    out = None
    for lo, hi, label in AGE_BANDS:
        cond = (age > lo) & (age <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def add_derived_features(df: DataFrame) -> DataFrame:
    """P7 + P8: lengthened stay, hospital death, age group."""
    new = {}
    if has(df, "ed_los_hours"):
        new["lengthened_ed_stay"] = F.coalesce(F.col("ed_los_hours") > LONG_STAY_HOURS,
                                               F.lit(False)).cast("int")
    if has(df, "hospital_expire_flag"):
        new["hospital_death"] = F.coalesce(F.col("hospital_expire_flag").cast("int"), F.lit(0))
    elif has(df, "deathtime"):
        new["hospital_death"] = F.col("deathtime").isNotNull().cast("int")
    if has(df, "age_at_ed"):
        new["age_group"] = age_band(F.col("age_at_ed"))
    return df.withColumns(new) if new else df


def apply_filters(t: Tables) -> DataFrame:
    """The full cohort chain J1→J2→J3→P2→P3→P4→P5→P6→P7→P8."""
    return (merge_initial(t)
            .transform(filter_admitted)
            .transform(filter_adults)
            .transform(filter_complete_triage)
            .transform(process_timestamps)
            .transform(with_ed_los)
            .transform(add_derived_features))


def cohort_funnel(t: Tables) -> DataFrame:
    """P10: rows left after each filter, from one aggregate over the joined
    stays (cumulative conditions), returned in long form."""
    df = merge_initial(t).transform(with_age_at_ed).transform(with_triage_completeness)
    admitted = admitted_condition(df)
    adult = admitted & adult_condition(df)
    complete = adult & triage_condition(df)
    agg = df.agg(F.count(F.lit(1)).alias("n0"), F.count_if(admitted).alias("n1"),
                 F.count_if(adult).alias("n2"), F.count_if(complete).alias("n3"))
    return to_long(agg, [(0, "all_stays", F.col("n0")), (1, "admitted", F.col("n1")),
                         (2, "adult", F.col("n2")), (3, "triage_complete", F.col("n3"))],
                   ["step_no", "step", "n_rows"])


def vital_zscores(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Z-score of each vital over the whole frame and |z| > 2 flags.

    Mean and sample std come from one global aggregate (a single row) read
    as scalar subqueries (Spark merges them into one aggregate job); no
    join and no unpartitioned window. A zero or undefined std gives a null z
    and a 0 flag.
    """
    cols = available_columns(df, cols or VITAL_COLS)
    if not cols:
        return df
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    new = {}
    for c in cols:
        mean, std = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        z = F.try_divide(F.col(c) - mean, F.when(std != 0, std))
        new[f"{c}_zscore"] = z
        new[f"{c}_abnormal"] = F.coalesce(F.abs(z) > 2, F.lit(False)).cast("int")
    return df.withColumns(new)


def vital_risk_score(df: DataFrame) -> DataFrame:
    """Number of abnormal vitals (sum of the ``*_abnormal`` flags)."""
    flags = [c for c in df.columns if c.endswith("_abnormal")]
    if not flags:
        return df
    return df.withColumn("vital_risk_score",
                         reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in flags]))
