"""Triage feature projection (P11–P14): one ``select``, no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import parse_number
from ..sources.schemas import has

# --- fixed values: target column -> accepted source columns, first found wins ---
VITAL_SOURCES: dict[str, list[str]] = {
    "triage_heart_rate": ["heartrate", "heart_rate"],
    "triage_respiratory_rate": ["resprate", "resp_rate", "respiratory_rate"],
    "triage_sbp": ["sbp", "systolic_bp"],
    "triage_dbp": ["dbp", "diastolic_bp"],
    "triage_temperature": ["temperature", "temp"],
    "triage_spo2": ["o2sat", "spo2", "oxygen_saturation"],
}


def first_available(df: DataFrame, sources: list[str]) -> Column:
    """The first source column the frame has, else a typed null."""
    for c in sources:
        if c in df.columns:
            return parse_number(F.col(c))
    return F.lit(None).cast("double")


def gender_flags(df: DataFrame) -> dict[str, Column]:
    """One-hot gender; null gender gives 0/0, no gender column gives 0/0."""
    if not has(df, "gender"):
        return {"triage_gender_male": F.lit(0), "triage_gender_female": F.lit(0)}
    g = F.col("gender").cast("string")
    return {"triage_gender_male": F.coalesce(g == "M", F.lit(False)).cast("int"),
            "triage_gender_female": F.coalesce(g == "F", F.lit(False)).cast("int")}


def extract_triage_features(df: DataFrame) -> DataFrame:
    """``triage_*`` columns: age, gender one-hot, six vitals, acuity,
    numeric pain (only if a pain column exists) and chief complaint ('' for
    null, only if the column exists)."""
    new: dict[str, Column] = {
        "triage_age": parse_number(F.col("age_at_ed")) if has(df, "age_at_ed")
        else F.lit(None).cast("double"),
    }
    new.update(gender_flags(df))
    for target, sources in VITAL_SOURCES.items():
        new[target] = first_available(df, sources)
    new["triage_acuity"] = parse_number(F.col("acuity")) if has(df, "acuity") else F.lit(None).cast("double")
    if has(df, "pain"):
        new["triage_pain"] = parse_number(F.col("pain"))
    if has(df, "chiefcomplaint"):
        new["triage_chief_complaint"] = F.coalesce(F.col("chiefcomplaint").cast("string"), F.lit(""))
    return df.withColumns(new)


TRIAGE_FEATURE_COLS = ["triage_age", "triage_gender_male", "triage_gender_female",
                       "triage_heart_rate", "triage_respiratory_rate", "triage_sbp", "triage_dbp",
                       "triage_temperature", "triage_spo2", "triage_acuity", "triage_pain",
                       "triage_chief_complaint"]
