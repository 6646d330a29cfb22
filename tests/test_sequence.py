"""Sequence linearization, formatting and the lab label vector."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edcohort.functions.fmt import one_decimal, py_str
from edcohort.operators import sequence as SQ
from edcohort.sources.labdim import LAB_GROUPS


def test_one_decimal_like_python(spark):
    vals = [0.25, 36.65, 97.45, 98.35, 36.75, 0.35, 1234567.25, -0.05, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(one_decimal("x").alias("s")).collect()]
    assert got == [f"{v:.1f}" for v in vals]


def test_py_str_like_python(spark):
    vals = [45.0, 0.1, 36.6, 12345678.0, 1e15, 2.5, -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(py_str("x").alias("s")).collect()]
    assert got == [str(v) for v in vals]


def _row(**kw):
    base = {f"lab_{g}_{k}": None for g in LAB_GROUPS for k in ("value", "time")}
    base.update({f"lab_{g}_ordered": 0 for g in LAB_GROUPS})
    base.update(dict(subject_id=1, hadm_id=1, stay_id=1, triage_gender_male=0, triage_gender_female=0,
                     triage_age=None, triage_heart_rate=None, triage_respiratory_rate=None, triage_sbp=None,
                     triage_dbp=None, triage_temperature=None, triage_spo2=None, triage_acuity=None,
                     triage_pain=None, triage_chief_complaint=None, outcome=1, lengthened_ed_stay=None,
                     cleaned_text=None))
    base.update(kw)
    return base


def _schema():
    fields = [T.StructField(n, T.LongType()) for n in ("subject_id", "hadm_id", "stay_id")]
    fields += [T.StructField(n, T.IntegerType()) for n in ("triage_gender_male", "triage_gender_female",
                                                            "outcome", "lengthened_ed_stay")]
    fields += [T.StructField(f"triage_{n}", T.DoubleType()) for n in
               ("age", "heart_rate", "respiratory_rate", "sbp", "dbp", "temperature", "spo2", "acuity", "pain")]
    fields += [T.StructField("triage_chief_complaint", T.StringType()), T.StructField("cleaned_text", T.StringType())]
    for g in LAB_GROUPS:
        fields += [T.StructField(f"lab_{g}_value", T.DoubleType()), T.StructField(f"lab_{g}_time", T.DoubleType()),
                   T.StructField(f"lab_{g}_ordered", T.IntegerType())]
    return T.StructType(fields)


def _df(spark, rows):
    s = _schema()
    return spark.createDataFrame([tuple(r[f.name] for f in s.fields) for r in rows], s)


def test_empty_triage_is_eos(spark):
    r = SQ.training_examples(_df(spark, [_row()])).collect()[0]
    assert r.text_sequence == "[EOS]" and r.eos_positions == [1] and r.num_labs == 0
    assert r.total_time_cost == 0 and r.critical_outcome == 1 and r.lengthened_ed_stay == 0


def test_full_sequence(spark):
    row = _row(triage_gender_female=1, triage_age=45.0, triage_temperature=36.65, triage_sbp=97.45,
               triage_pain=7.0, triage_chief_complaint="chest|pain",
               lab_CBC_ordered=1, lab_CBC_value=12.5, lab_CBC_time=2.0,
               lab_CHEM_ordered=1, lab_CHEM_value=None, lab_CHEM_time=None,     # ordered, no value/time
               lab_UA_ordered=1, lab_UA_value=1.0, lab_UA_time=2.0,             # time tie with CBC
               lab_LACTATE_ordered=1, lab_LACTATE_value=0.9, lab_LACTATE_time=1.0,
               lab_TOX_ordered=1, lab_TOX_value=3.0, lab_TOX_time=0.5,          # not a sequence group
               cleaned_text="note")
    r = SQ.training_examples(_df(spark, [row])).collect()[0]
    triage = ("gender: Female | age: 45.0 | sbp: 97.5 | temperature: 36.6 | pain: 7.0 | "
              "chief_complaint: chest;pain | [EOS]")
    assert r.text_sequence == " ".join([triage, "LACTATE: 0.9 | [EOS]", "CBC: 12.5 | [EOS]", "UA: 1.0 | [EOS]",
                                        "CHEM: ordered | [EOS]"])
    assert r.lab_groups == ["LACTATE", "CBC", "UA", "CHEM"]
    assert r.time_costs == [4, 30, 40, 60] and r.total_time_cost == 134
    assert r.eos_positions[-1] == len(r.text_sequence.split())
    assert r.eos_positions == [len(triage.split()) + 4 * i for i in range(5)]
    assert r.has_text and r.clinical_text == "note"


def test_dict_value_segment(spark):
    df = spark.createDataFrame([("G", "{'a': 1, 'b': 'x'}"), ("G", "7.5"), ("G", None)], "group string, value string")
    item = F.struct("group", "value")
    got = [r.s for r in df.select(SQ.lab_group_text(item).alias("s")).collect()]
    assert got == ["G: a: 1 | b: x | [EOS]", "G: 7.5 | [EOS]", "G: ordered | [EOS]"]


def test_label_vector(spark):
    groups = [[], ["CBC"], ["CBC", "CHEM", "COAG", "UA", "LACTATE", "LFTS", "LIPASE", "LYTES", "BLOOD_GAS",
                            "CARDIO", "TOX", "INFLAM", "CBC"]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, lab_groups array<string>")
    out = {r.i: r for r in SQ.lab_label_vector(df).collect()}
    assert out[0].lab_group_labels == [-100] * 12 and out[0].num_labs == 0
    assert out[1].lab_group_labels == [0] + [-100] * 11
    assert out[2].lab_group_labels == list(range(12)) and out[2].num_labs == 13
