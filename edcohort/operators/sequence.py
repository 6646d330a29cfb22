"""Sequence linearization (L1–L6, A27, A28): each stay becomes a text
sequence with aligned arrays, built from column expressions and
higher-order functions (no row loop, no Python worker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import dict_parts, opens_dict, one_decimal, py_str
from ..functions.frames import pct
from ..functions.text import complaint_text, token_count
from ..sources.labdim import GROUP_CLASS_ID, GROUP_MINUTES, SEQUENCE_GROUPS
from ..sources.schemas import has

EOS = "[EOS]"
PAD = -100
MAX_GROUPS = 12
MAX_SEQUENCE_TOKENS = 656
# --- fixed values: triage fields of the sequence, in order (name, column) ---
TRIAGE_FIELDS = [("age", "triage_age"), ("heart_rate", "triage_heart_rate"),
                 ("respiratory_rate", "triage_respiratory_rate"), ("sbp", "triage_sbp"),
                 ("dbp", "triage_dbp"), ("temperature", "triage_temperature"), ("spo2", "triage_spo2"),
                 ("acuity", "triage_acuity"), ("pain", "triage_pain"),
                 ("chief_complaint", "triage_chief_complaint")]
ONE_DECIMAL_FIELDS = {"temperature", "sbp", "dbp", "spo2"}
DEFAULT_TIME_COST = 60


def _value_text(df: DataFrame, name: str, col: str) -> Column:
    c = F.col(col)
    if name == "chief_complaint":
        return complaint_text(c)
    if name in ONE_DECIMAL_FIELDS:
        return one_decimal(c)
    dtype = df.schema[col].dataType.typeName()
    return py_str(c) if dtype in ("double", "float") else c.cast("string")


def linearize_triage(df: DataFrame) -> Column:
    """L1: ``gender: Male | age: 45.0 | ... | [EOS]``; null fields are
    skipped; nothing present gives ``[EOS]``."""
    parts = []
    male = F.col("triage_gender_male") == 1 if has(df, "triage_gender_male") else F.lit(False)
    female = F.col("triage_gender_female") == 1 if has(df, "triage_gender_female") else F.lit(False)
    parts.append(F.when(male, F.lit("gender: Male")).when(female, F.lit("gender: Female")))
    for name, col in TRIAGE_FIELDS:
        if has(df, col):
            parts.append(F.when(F.col(col).isNotNull(),
                                F.concat(F.lit(f"{name}: "), _value_text(df, name, col))))
    return F.concat_ws(" | ", *parts, F.lit(EOS))


def performed_groups(df: DataFrame, groups: list[str] | None = None) -> Column:
    """L2: ordered groups as structs (group, value, time, time_cost), sorted
    by time; groups without a time follow in declared order."""
    groups = groups or SEQUENCE_GROUPS
    items = []
    for pos, g in enumerate(groups):
        flag, val, tm = f"lab_{g}_ordered", f"lab_{g}_value", f"lab_{g}_time"
        if not has(df, flag):
            continue
        is_text = has(df, val) and df.schema[val].dataType.typeName() == "string"
        text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
        if has(df, val):
            text, number = (F.col(val), number) if is_text else (text, F.col(val).cast("double"))
        items.append(F.when(F.col(flag) == 1, F.struct(
            F.col(tm).isNull().alias("no_time") if has(df, tm) else F.lit(True).alias("no_time"),
            (F.col(tm).cast("double") if has(df, tm) else F.lit(None).cast("double")).alias("time"),
            F.lit(pos).alias("pos"), F.lit(g).alias("group"), text.alias("text"), number.alias("number"),
            F.lit(GROUP_MINUTES.get(g, DEFAULT_TIME_COST)).alias("time_cost"))))
    if not items:
        return F.array().cast("array<struct<no_time:boolean,time:double,pos:int,group:string,"
                              "value:string,time_cost:int>>")
    # numbers become text once, for the ordered groups only
    return F.transform(F.array_sort(F.filter(F.array(*items), lambda x: x.isNotNull())), lambda x: F.struct(
        x["no_time"].alias("no_time"), x["time"].alias("time"), x["pos"].alias("pos"), x["group"].alias("group"),
        F.coalesce(x["text"], py_str(x["number"])).alias("value"), x["time_cost"].alias("time_cost")))


def lab_group_text(item: Column) -> Column:
    """L3: ``G: value | [EOS]``; a dict value gives ``G: k: v | ... | [EOS]``;
    no value gives ``G: ordered | [EOS]``."""
    parts = dict_parts(item["value"])
    return (F.when(item["value"].isNull(), F.concat(item["group"], F.lit(": ordered | " + EOS)))
             .when(~opens_dict(item["value"]), F.concat(item["group"], F.lit(": "), item["value"], F.lit(" | " + EOS)))
             .when(parts.isNotNull() & (F.size(parts) > 0),
                   F.concat(item["group"], F.lit(": "), F.array_join(parts, " | "), F.lit(" | " + EOS)))
             .otherwise(F.concat(item["group"], F.lit(": "), item["value"], F.lit(" | " + EOS))))


def linearize_sequence(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """L4: full sequence + ``lab_groups``, ``time_costs``, cumulative
    ``eos_positions`` (whitespace tokens), ``total_time_cost``, ``num_labs``."""
    df = df.withColumns({"__triage": linearize_triage(df), "__perf": performed_groups(df, groups)})
    df = df.withColumn("__lab_texts", F.transform("__perf", lab_group_text))
    tokens = F.transform("__lab_texts", lambda t: token_count(t))
    eos = F.aggregate(tokens, F.array(token_count("__triage")),
                      lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    costs = F.transform("__perf", lambda x: x["time_cost"])
    return df.withColumns({
        "text_sequence": F.array_join(F.concat(F.array("__triage"), F.col("__lab_texts")), " "),
        "lab_groups": F.transform("__perf", lambda x: x["group"]),
        "time_costs": costs,
        "eos_positions": eos,
        "total_time_cost": F.aggregate(costs, F.lit(0), lambda a, x: a + x),
        "num_labs": F.size("__perf"),
    }).drop("__triage", "__perf", "__lab_texts")


def training_examples(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Ids, sequence columns, labels and clinical text per stay.
    ``critical_outcome`` falls back to ``outcome``; the lengthened-stay
    label is read under either name (0 when absent)."""
    seq = linearize_sequence(df, groups)
    outcome = F.coalesce(F.col("outcome"), F.lit(0)) if has(df, "outcome") else F.lit(0)
    critical = F.col("critical_outcome") if has(df, "critical_outcome") else outcome
    length_col = next((c for c in ("lengthened_ed_stay", "lengthened_stay") if has(df, c)), None)
    lengthened = F.coalesce(F.col(length_col), F.lit(0)) if length_col else F.lit(0)
    text = F.col("cleaned_text") if has(df, "cleaned_text") else F.lit(None).cast("string")
    return seq.select("subject_id", "hadm_id", "stay_id", "text_sequence", "lab_groups", "time_costs",
                      "eos_positions", "total_time_cost", "num_labs", outcome.alias("outcome"),
                      critical.alias("critical_outcome"), lengthened.alias("lengthened_ed_stay"),
                      text.alias("clinical_text"), text.isNotNull().alias("has_text"),
                      *[c for c in ("split",) if has(df, c)])


def lab_label_vector(df: DataFrame, max_groups: int = MAX_GROUPS, pad: int = PAD) -> DataFrame:
    """Class ids of ``lab_groups`` (upper-cased names), cut to
    ``max_groups`` and padded with ``pad``; plus ``num_labs``."""
    ids = F.create_map(*[x for g, i in GROUP_CLASS_ID.items() for x in (F.lit(g.upper()), F.lit(i))])
    mapped = F.transform("lab_groups", lambda g: F.element_at(ids, F.upper(g)))
    cut = F.slice(mapped, 1, max_groups)
    padded = F.concat(cut, F.array_repeat(F.lit(pad), F.lit(max_groups) - F.size(cut)))
    return df.withColumns({"lab_group_labels": padded, "num_labs": F.size("lab_groups")})


def lab_group_frequency(df: DataFrame) -> DataFrame:
    """How often each group appears over the ``lab_groups`` arrays and
    the share of stays (%). Partial counts are combined map-side."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.select(F.explode("lab_groups").alias("lab_group")).groupBy("lab_group").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct_of_stays", pct(F.col("n"), total))


def sequence_stats(df: DataFrame, max_tokens: int = MAX_SEQUENCE_TOKENS) -> DataFrame:
    """Token statistics of the sequences and example counts."""
    tok = token_count("text_sequence")
    return df.agg(F.count(F.lit(1)).alias("n_examples"), F.avg(tok).alias("mean_tokens"),
                  F.max(tok).alias("max_tokens"), F.count_if(tok > max_tokens).alias("n_over_max"),
                  F.avg("num_labs").alias("mean_groups"), F.avg("total_time_cost").alias("mean_time_cost"),
                  F.count_if(F.col("num_labs") == 0).alias("n_without_labs"),
                  F.count_if(F.col("has_text")).alias("n_with_text"),
                  F.count_if(F.col("outcome") == 1).alias("n_positive"))
