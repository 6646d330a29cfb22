"""Sources: CSV and Parquet scans of the clinical tables.

Everything here returns lazy DataFrames. Id filters are semi joins against
other DataFrames, so id sets are never collected to the driver; item filters
are literal ``isin`` lists that Parquet can push down.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labdim import relevant_itemids
from .schemas import NOTE_CATEGORIES, SCHEMAS, SOURCE_FILES, has

# --- fixed values: strings read as missing in CSV sources ---
NULL_TOKENS = ["", "NA", "NULL", "null", "nan", "NaN", "N/A", "n/a", "NAN", "#N/A",
               "-NaN", "-nan", "None", "<NA>", "1.#IND", "1.#QNAN", "-1.#IND",
               "-1.#QNAN", "#N/A N/A", "#NA"]


@dataclass
class Tables:
    """The named table set. Every member is a lazy DataFrame or None."""
    edstays: DataFrame | None = None
    patients: DataFrame | None = None
    triage: DataFrame | None = None
    admissions: DataFrame | None = None
    icustays: DataFrame | None = None
    labevents: DataFrame | None = None
    vitalsign: DataFrame | None = None
    diagnosis: DataFrame | None = None
    medrecon: DataFrame | None = None
    diagnoses_icd: DataFrame | None = None
    d_labitems: DataFrame | None = None
    notes: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def items(self):
        for f in fields(self):
            if f.name != "extra" and getattr(self, f.name) is not None:
                yield f.name, getattr(self, f.name)

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)


#: What every table of stays must carry.
STAY_KEYS = ["stay_id", "subject_id"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system (local, HDFS, object store)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def check_input(df: DataFrame | None, name: str, columns: list[str], non_empty: bool = True) -> DataFrame:
    """The contract of a required input: present, with these columns,
    not empty (one row is read to see that)."""
    if df is None:
        raise ValueError(f"required table {name} is missing")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks required columns {missing}")
    if non_empty and df.isEmpty():
        raise ValueError(f"required table {name} is empty")
    return df


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def null_tokens_to_null(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """CSV null rule: any listed token (after trimming) becomes null.

    Spark's ``nullValue`` option takes one token only, so the rest is a
    projection over the string columns.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.trim(F.col(f.name)).isin(tokens), F.lit(None))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   usecols: list[str] | None = None, multiline: bool = False,
                   missing: str = "empty") -> DataFrame:
    """Header CSV → typed table. A missing file gives an empty table, or
    raises with ``missing="error"``.

    Columns are read as strings by name (no positional schema, no inference
    pass), null tokens are mapped, then each declared column is cast with
    ``try_cast`` so an unparsable value becomes null instead of failing.
    """
    if not path_exists(spark, path):
        if missing == "error":
            raise FileNotFoundError(path)
        target = schema if schema is not None else T.StructType([])
        if usecols:
            target = T.StructType([f for f in target.fields if f.name in usecols])
        return empty_table(spark, target)
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE"))
    if multiline:
        reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"')
    raw = reader.csv(path)
    if usecols:
        raw = raw.select(*[c for c in usecols if c in raw.columns])
    raw = null_tokens_to_null(raw)
    if schema is None:
        return raw
    declared = [f for f in schema.fields if f.name in raw.columns]
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in declared],
                      *[F.col(c) for c in raw.columns if c not in schema.fieldNames()])


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "csv",
               usecols: list[str] | None = None, missing: str = "empty") -> DataFrame:
    """S8 + S1: one source table by logical name, CSV or Parquet; a missing
    one is empty or an error. A ``.csv.gz`` is read by one task: convert large
    ones to Parquet once."""
    rel = SOURCE_FILES.get(name, name)
    if fmt == "parquet":
        path = os.path.join(root, rel + ".parquet")
        if not path_exists(spark, path):
            if missing == "error":
                raise FileNotFoundError(path)
            return empty_table(spark, SCHEMAS[name])
        df = spark.read.parquet(path)
        return df.select(*[c for c in usecols if c in df.columns]) if usecols else df
    path = os.path.join(root, rel + ".csv")
    if not path_exists(spark, path) and path_exists(spark, path + ".gz"):
        path = path + ".gz"
    return read_csv_table(spark, path, SCHEMAS.get(name), usecols, missing=missing)


def load_tables(spark: SparkSession, root: str, fmt: str = "csv",
                load_labs: bool = True, load_vitals: bool = True,
                sample_stays: int | None = None, lab_strategy: str = "filtered",
                lab_max_rows: int | None = None) -> Tables:
    """The whole table set. Stays and patients must exist and hold rows;
    other missing files are empty tables. Admissions, ICU stays and lab events
    are those of patients with an ED stay, ICD rows those of the loaded
    admissions (semi joins, so no id set is collected); vital signs are the eleven
    columns (S4), of the sampled stays if there is a sample. Loading is lazy, so the
    memory switches of a row-at-a-time loader reduce to which scans are planned
    at all."""
    t = Tables(
        patients=read_table(spark, root, "patients", fmt,
                            ["subject_id", "gender", "anchor_age", "anchor_year",
                             "anchor_year_group", "dod"], missing="error"),
        edstays=read_table(spark, root, "edstays", fmt, missing="error"),
        triage=read_table(spark, root, "triage", fmt),
        diagnosis=read_table(spark, root, "diagnosis", fmt),
        medrecon=read_table(spark, root, "medrecon", fmt),
        admissions=read_table(spark, root, "admissions", fmt),
        diagnoses_icd=read_table(spark, root, "diagnoses_icd", fmt,
                                 ["subject_id", "hadm_id", "icd_code", "icd_version"]),
        d_labitems=read_table(spark, root, "d_labitems", fmt),
        icustays=read_table(spark, root, "icustays", fmt,
                            ["subject_id", "hadm_id", "stay_id", "intime", "outtime"]),
    )
    check_input(t.edstays, "edstays", STAY_KEYS)
    check_input(t.patients, "patients", ["subject_id"])
    if sample_stays is not None:
        t = sample_tables(t, sample_stays)
    if load_vitals:
        t.vitalsign = scan_vitalsign(read_table(spark, root, "vitalsign", fmt, VITAL_COLS),
                                     t.edstays if sample_stays is not None else None)
    seen = t.edstays.select("subject_id").distinct()
    t.admissions = t.admissions.join(seen, "subject_id", "left_semi")
    t.icustays = t.icustays.join(seen, "subject_id", "left_semi")
    t.diagnoses_icd = t.diagnoses_icd.join(t.admissions.select("hadm_id").distinct(), "hadm_id", "left_semi")
    if load_labs:
        raw = read_table(spark, root, "labevents", fmt,
                         ["subject_id", "hadm_id", "itemid", "charttime", "valuenum", "valueuom"])
        t.labevents = scan_labevents(raw, patients=seen, strategy=lab_strategy,
                                     max_rows=lab_max_rows)
    return t


def assemble_tables(t: Tables, load_labs: bool = True, load_vitals: bool = True,
                    sample_stays: int | None = None, lab_strategy: str = "filtered",
                    lab_max_rows: int | None = None) -> Tables:
    """S2 on already-read sources: optional stay sample (S14), lab events of
    the loaded patients under the chosen strategy (S3/S3a), vital signs of
    the loaded stays (S4). Nothing is counted or collected here."""
    out = sample_tables(t, sample_stays) if sample_stays is not None else t.with_()
    if not load_vitals:
        out.vitalsign = None
    elif out.vitalsign is not None:
        out.vitalsign = scan_vitalsign(out.vitalsign, out.edstays)
    if load_labs and t.labevents is not None:
        out.labevents = scan_labevents(t.labevents, patients=out.patients, strategy=lab_strategy,
                                       max_rows=lab_max_rows)
    elif not load_labs:
        out.labevents = None
    return out


def scan_labevents(labevents: DataFrame, patients: DataFrame | None = None,
                   stays: DataFrame | None = None, strategy: str = "filtered",
                   itemids: list[int] | None = None, max_rows: int | None = None) -> DataFrame:
    """Lab events with a value, of cohort patients, of relevant items.

    ``filtered``: the relevant items only (a literal list, pushed into the
    Parquet scan). ``sample``: the first ``max_rows`` rows in key order (the
    cap is the feature of this strategy and must be given). ``full``: no item
    filter.
    """
    if strategy == "sample" and max_rows is None:
        raise ValueError("strategy 'sample' needs max_rows")
    cols = [c for c in ["subject_id", "hadm_id", "itemid", "charttime", "valuenum", "valueuom"]
            if c in labevents.columns]
    df = labevents.select(*cols).where(F.col("valuenum").isNotNull())
    if strategy == "filtered":
        df = df.where(F.col("itemid").isin(itemids or relevant_itemids()))
    if patients is not None:
        df = df.join(patients.select("subject_id").distinct(), "subject_id", "left_semi")
    if stays is not None and has(stays, "hadm_id"):
        df = df.join(stays.select("subject_id", "hadm_id").distinct(),
                     ["subject_id", "hadm_id"], "left_semi")
    if strategy == "sample":
        from ..operators.split import first_n
        df = first_n(df, max_rows, ["subject_id", "hadm_id", "charttime", "itemid", "valuenum"])
    return df


VITAL_COLS = ["subject_id", "stay_id", "charttime", "temperature", "heartrate", "resprate",
              "o2sat", "sbp", "dbp", "rhythm", "pain"]


def scan_vitalsign(vitalsign: DataFrame, stays: DataFrame | None = None) -> DataFrame:
    """The eleven vital-sign columns, optionally of given stays."""
    df = vitalsign.select(*[c for c in VITAL_COLS if c in vitalsign.columns])
    if stays is not None:
        df = df.join(stays.select("stay_id").distinct(), "stay_id", "left_semi")
    return df


def tag_notes(notes: DataFrame, category: str, priority: int | None = None) -> DataFrame:
    """Category tag, priority and the non-empty-text rule (P15) for one source."""
    prio = NOTE_CATEGORIES.get(category, {}).get("priority") if priority is None else priority
    return (notes.where(F.col("text").isNotNull() & (F.length("text") > 0))
            .withColumn("note_category", F.lit(category))
            .withColumn("category_priority", F.lit(prio).cast("int")))


def load_notes(spark: SparkSession, root: str, categories: list[str] | None = None,
               subjects: DataFrame | None = None, admissions: DataFrame | None = None,
               fmt: str = "csv", missing: str = "error") -> DataFrame:
    """S5 + U1: note sources (multi-line quoted CSV or Parquet), filtered to
    given patients/admissions by semi join, tagged, unioned by name. A category
    without a file is an error, or left out with ``missing="skip"``. A
    multi-line CSV is read by one task per file: convert large ones to Parquet
    once."""
    parts = []
    for cat in categories or list(NOTE_CATEGORIES):
        rel = NOTE_CATEGORIES[cat]["file"]
        if fmt == "parquet":
            path = os.path.join(root, rel + ".parquet")
        else:
            path = os.path.join(root, rel + ".csv")
        if not path_exists(spark, path):
            if missing == "skip":
                continue
            raise FileNotFoundError(path)
        if fmt == "parquet":
            df = spark.read.parquet(path)
        else:
            df = read_csv_table(spark, path, SCHEMAS["notes"], multiline=True)
        parts.append(tag_notes(df, cat))
    if not parts:
        raise ValueError("no note source found under " + root)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return filter_notes_by_ids(out, subjects, admissions)


def filter_notes_by_ids(notes: DataFrame, subjects: DataFrame | None = None,
                        admissions: DataFrame | None = None) -> DataFrame:
    """Id-set filters as semi joins (ids stay distributed)."""
    if subjects is not None:
        notes = notes.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    if admissions is not None:
        notes = notes.join(admissions.select("hadm_id").distinct(), "hadm_id", "left_semi")
    return notes


def sample_tables(t: Tables, n_stays: int) -> Tables:
    """The first ``n_stays`` stays in key order, dependents follow.

    Unlike a file-order peek of each table, patients and admissions are
    reduced to the sampled stays by semi join, so no sampled stay loses its
    patient. The cap is the feature of this operator.
    """
    from ..operators.split import first_n
    stays = first_n(t.edstays, n_stays, ["stay_id"])
    out = t.with_(edstays=stays)
    out.patients = t.patients.join(stays.select("subject_id"), "subject_id", "left_semi")
    if t.triage is not None:
        out.triage = t.triage.join(stays.select("stay_id"), "stay_id", "left_semi")
    for name in ("admissions", "diagnoses_icd", "icustays"):
        df = getattr(t, name)
        if df is not None and has(df, "hadm_id"):
            setattr(out, name, df.join(stays.select("hadm_id").where(F.col("hadm_id").isNotNull()),
                                       "hadm_id", "left_semi"))
    for name in ("diagnosis", "medrecon", "vitalsign"):
        df = getattr(t, name)
        if df is not None and has(df, "stay_id"):
            setattr(out, name, df.join(stays.select("stay_id"), "stay_id", "left_semi"))
    return out
