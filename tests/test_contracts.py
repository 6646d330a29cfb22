"""Loader paths and contracts, checkpoint folder, stage tables, number text."""
import pytest
from pyspark.sql import functions as F

from edcohort import session
from edcohort.functions.fmt import dict_parts, py_str
from edcohort.sources import readers
from edcohort.sources.sinks import write_stage


def write_set(root, empty=()):
    files = {
        "core/patients.csv": ["subject_id,gender,anchor_age,anchor_year", "1,F,40,2000", "2,M,50,2000", "3,F,60,2000"],
        "ed/edstays.csv": ["stay_id,subject_id,hadm_id,intime,outtime",
                           "10,1,100,2020-01-01 00:00:00,2020-01-01 05:00:00",
                           "11,2,,2020-01-02 00:00:00,2020-01-02 05:00:00"],
        "hosp/admissions.csv": ["subject_id,hadm_id,admittime,dischtime", "1,100,2020-01-01 05:00:00,",
                                "3,300,2020-01-01 05:00:00,"],
        "hosp/diagnoses_icd.csv": ["subject_id,hadm_id,icd_code,icd_version", "1,100,I10,10", "3,300,I10,10"],
        "hosp/labevents.csv": ["subject_id,hadm_id,itemid,charttime,valuenum",
                               *(f"{s},{s}00,{item},2020-01-01 01:00:00,1.5" for s in (1, 3)
                                 for item in (readers.relevant_itemids()[0], 99999))],
    }
    for rel, lines in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines[:1] if rel in empty else lines) + "\n")


def test_loader_same_for_paths_and_uris(spark, tmp_path):
    write_set(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        t = readers.load_tables(spark, root)
        counts = {k: v.count() for k, v in t.items()}
        assert counts["edstays"] == 2 and counts["patients"] == 3
        # patient 3 has no ED stay
        assert counts["admissions"] == counts["diagnoses_icd"] == counts["labevents"] == 1
        assert counts["triage"] == counts["icustays"] == 0
        assert readers.load_tables(spark, root, lab_strategy="full").labevents.count() == 2


def test_required_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load_tables(spark, str(tmp_path))
    write_set(tmp_path, empty=("ed/edstays.csv",))
    with pytest.raises(ValueError, match="edstays is empty"):
        readers.load_tables(spark, str(tmp_path))
    with pytest.raises(ValueError, match="lacks required columns"):
        readers.check_input(spark.range(1), "edstays", ["stay_id"])
    with pytest.raises(ValueError, match="is missing"):
        readers.check_input(None, "edstays", [])


def test_missing_note_source_is_an_error(spark, tmp_path):
    (tmp_path / "discharge.csv").write_text(
        'note_id,subject_id,hadm_id,note_type,charttime,text\nn1,1,100,DS,2020-01-01 00:00:00,"two\nlines"\n')
    with pytest.raises(FileNotFoundError):
        readers.load_notes(spark, f"file://{tmp_path}")
    got = readers.load_notes(spark, f"file://{tmp_path}", missing="skip").collect()
    assert [(r.note_id, r.text, r.note_category) for r in got] == [("n1", "two\nlines", "discharge")]


def test_sample_strategy_needs_its_size(spark):
    labs = spark.createDataFrame([(1, 1, 5, None, 1.0)], "subject_id long, hadm_id long, itemid int, "
                                                         "charttime timestamp_ntz, valuenum double")
    with pytest.raises(ValueError, match="max_rows"):
        readers.scan_labevents(labs, strategy="sample")


class _Session:
    """A session on some master without a checkpoint folder."""

    def __init__(self, master):
        context = type("C", (), {"master": master, "getConf": lambda s: self, "setCheckpointDir": lambda s, d: None})
        self.sparkContext, self.conf = context(), self

    def get(self, key, default=None):
        return None

    def set(self, key, value):
        pass


def test_checkpoint_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(_Session(master))
    for master in ("local", "local[*]", "local[4,2]"):
        assert session.ensure_checkpoint_dir(_Session(master))


def test_two_runs_keep_their_stage_tables(spark):
    first = write_stage(spark.range(3), "cohort", spark)
    second = write_stage(spark.range(5), "cohort", spark)
    assert (first.count(), second.count()) == (3, 5)


NUMBERS = [0.0001, 1e-05, 0.00017, 12345678.5, 1e16, 1.5e16, 123456789012345.6, 9999999.0, 1e7, 1e15, 0.001, 0.5,
           -0.00002, -12345678.25, 3.0, 0.1 + 0.2, 1.7976931348623157e308, 2.5e-300, 100.0, 1234567.125]


def test_numbers_print_like_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", py_str("x").alias("s")).collect()}
    assert got == {i: str(x) for i, x in enumerate(NUMBERS)}
    special = df.limit(1).select(py_str(F.lit(float("nan"))).alias("a"), py_str(F.lit(float("-inf"))).alias("b"),
                                 py_str(F.lit(None).cast("double")).alias("c")).first()
    assert tuple(special) == ("nan", "-inf", None)


DICTS = [
    ('{"a": "patient\'s", "b": 2}', ["a: patient's", "b: 2"]),
    ("{'a': 1, 'b': None}", ["a: 1", "b: None"]),
    ("{'x y': 'text', 'ok': True}", ["x y: text", "ok: True"]),
    ("{'a': 0.5}", ["a: 0.5"]), ("{}", []), ("12.5", None), ("not {a} dict", None), (None, None),
]


def test_dict_text(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DICTS)], "i int, d string")
    got = {r.i: r.p for r in df.select("i", dict_parts("d").alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(DICTS)}
