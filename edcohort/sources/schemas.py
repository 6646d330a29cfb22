"""Declared schemas of the clinical source tables.

Sources are read with these schemas (no inference). Columns a source does not
carry are projected as typed nulls by :func:`conform`, so every downstream
operator can rely on one fixed layout while still honouring the "use it only
if present" rules, which are decided from the schema on the driver and cost
no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "patients": _schema(("subject_id", L), ("gender", S), ("anchor_age", I),
                        ("anchor_year", I), ("anchor_year_group", S), ("dod", TS)),
    "edstays": _schema(("stay_id", L), ("subject_id", L), ("hadm_id", L),
                       ("intime", TS), ("outtime", TS)),
    "triage": _schema(("stay_id", L), ("temperature", D), ("heartrate", D),
                      ("resprate", D), ("o2sat", D), ("sbp", D), ("dbp", D),
                      ("acuity", D), ("pain", S), ("chiefcomplaint", S)),
    "vitalsign": _schema(("subject_id", L), ("stay_id", L), ("charttime", TS),
                         ("temperature", D), ("heartrate", D), ("resprate", D),
                         ("o2sat", D), ("sbp", D), ("dbp", D), ("rhythm", S), ("pain", S)),
    "diagnosis": _schema(("subject_id", L), ("stay_id", L), ("seq_num", I),
                         ("icd_code", S), ("icd_version", I), ("icd_title", S)),
    "medrecon": _schema(("subject_id", L), ("stay_id", L), ("charttime", TS),
                        ("name", S), ("gsn", S), ("ndc", S), ("etc_rn", I),
                        ("etccode", S), ("etcdescription", S)),
    "admissions": _schema(("subject_id", L), ("hadm_id", L), ("admittime", TS),
                          ("dischtime", TS), ("deathtime", TS),
                          ("hospital_expire_flag", I), ("admission_type", S),
                          ("admission_location", S), ("discharge_location", S)),
    "diagnoses_icd": _schema(("subject_id", L), ("hadm_id", L), ("seq_num", I),
                             ("icd_code", S), ("icd_version", I)),
    "d_labitems": _schema(("itemid", I), ("label", S), ("fluid", S), ("category", S)),
    "labevents": _schema(("subject_id", L), ("hadm_id", L), ("itemid", I),
                         ("charttime", TS), ("valuenum", D), ("valueuom", S)),
    "icustays": _schema(("subject_id", L), ("hadm_id", L), ("stay_id", L),
                        ("intime", TS), ("outtime", TS)),
    "notes": _schema(("note_id", S), ("subject_id", L), ("hadm_id", L),
                     ("note_type", S), ("note_seq", I), ("charttime", TS),
                     ("chartdate", TS), ("storetime", TS), ("text", S)),
}

# Source file of each table inside a clinical export (relative paths).
SOURCE_FILES: dict[str, str] = {
    "patients": "core/patients", "edstays": "ed/edstays", "triage": "ed/triage",
    "vitalsign": "ed/vitalsign", "diagnosis": "ed/diagnosis", "medrecon": "ed/medrecon",
    "admissions": "hosp/admissions", "diagnoses_icd": "hosp/diagnoses_icd",
    "d_labitems": "hosp/d_labitems", "labevents": "hosp/labevents",
    "icustays": "icu/icustays",
}

# --- fixed values: note categories, their files and loader priority ---
NOTE_CATEGORIES: dict[str, dict] = {
    "discharge": {"file": "discharge", "priority": 1},
    "radiology": {"file": "radiology", "priority": 2},
}


def has(df: DataFrame, *cols: str) -> bool:
    """Schema check on the driver; never triggers a job."""
    names = set(df.columns)
    return all(c in names for c in cols)


#: Feature columns of the multimodal table start with one of these.
FEATURE_PREFIXES = ("triage_", "lab_")


def columns_with(df: DataFrame, *prefixes: str, without: bool = False) -> list[str]:
    """The columns whose names start with one of ``prefixes`` (or with none)."""
    return [c for c in df.columns if c.startswith(prefixes) != without]


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Cast present columns to the declared type and add absent ones as nulls."""
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).try_cast(field.dataType).alias(field.name)
                        if df.schema[field.name].dataType != field.dataType
                        else F.col(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    if keep_extra:
        declared = {f.name for f in schema.fields}
        cols += [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols)
