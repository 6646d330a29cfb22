"""Sources and sinks: CSV null tokens, missing files, multi-line notes,
partitioned Parquet, summary CSV, stage tables, table loading."""
import os
import tempfile

from edcohort.sources import readers as R
from edcohort.sources.schemas import SCHEMAS
from edcohort.sources.sinks import write_parquet, write_stage, write_summary_csv


def test_csv_null_tokens_and_casts(spark):
    d = tempfile.mkdtemp(prefix="edc-io-")
    p = os.path.join(d, "triage.csv")
    with open(p, "w") as f:
        f.write("stay_id,temperature,heartrate,resprate,o2sat,sbp,dbp,acuity,pain,chiefcomplaint\n")
        f.write("1,NA,80,NULL,nan,120,80,3,7,cough\n")
        f.write("2,37.5,,null,99,abc,80,2,unable,\n")
    df = R.read_csv_table(spark, p, SCHEMAS["triage"])
    rows = {r.stay_id: r for r in df.collect()}
    assert rows[1].temperature is None and rows[1].resprate is None and rows[1].o2sat is None
    assert rows[1].heartrate == 80.0 and rows[2].sbp is None and rows[2].pain == "unable"
    assert rows[2].chiefcomplaint is None


def test_missing_file_is_empty(spark):
    df = R.read_csv_table(spark, "/nonexistent/x.csv", SCHEMAS["labevents"])
    assert df.count() == 0 and "valuenum" in df.columns


def test_multiline_notes_and_load(spark):
    d = tempfile.mkdtemp(prefix="edc-notes-")
    with open(os.path.join(d, "discharge.csv"), "w") as f:
        f.write('note_id,subject_id,hadm_id,note_type,note_seq,charttime,text\n')
        f.write('n1,1,10,DS,1,2020-01-01 10:00:00,"line one\nline ""two"", more"\n')
        f.write('n2,1,10,DS,2,2020-01-01 11:00:00,""\n')
    with open(os.path.join(d, "radiology.csv"), "w") as f:
        f.write('note_id,subject_id,hadm_id,note_type,note_seq,charttime,text\n')
        f.write('r1,2,20,RR,1,bad-time,"x"\n')
    notes = R.load_notes(spark, d)
    rows = {r.note_id: r for r in notes.collect()}
    assert set(rows) == {"n1", "r1"}                       # empty text dropped
    assert rows["n1"].text == 'line one\nline "two", more'
    assert rows["n1"].note_category == "discharge" and rows["n1"].category_priority == 1
    assert rows["r1"].charttime is None                    # unparsable time → null
    subj = spark.createDataFrame([(2,)], "subject_id long")
    assert [r.note_id for r in R.load_notes(spark, d, subjects=subj).collect()] == ["r1"]


def test_load_tables_and_sample(spark):
    d = tempfile.mkdtemp(prefix="edc-tables-")
    for sub in ("core", "ed", "hosp", "icu"):
        os.makedirs(os.path.join(d, sub))
    with open(os.path.join(d, "core/patients.csv"), "w") as f:
        f.write("subject_id,gender,anchor_age,anchor_year\n1,M,40,2020\n2,F,50,2020\n")
    with open(os.path.join(d, "ed/edstays.csv"), "w") as f:
        f.write("stay_id,subject_id,hadm_id,intime,outtime\n")
        f.write("1,1,10,2020-01-01 00:00:00,2020-01-01 05:00:00\n2,2,,2020-01-01 00:00:00,2020-01-01 05:00:00\n")
    with open(os.path.join(d, "hosp/labevents.csv"), "w") as f:
        f.write("subject_id,hadm_id,itemid,charttime,valuenum,valueuom\n")
        f.write("1,10,51221,2020-01-01 01:00:00,40,%\n1,10,99999,2020-01-01 01:00:00,1,x\n1,10,51221,2020-01-01 01:00:00,,%\n")
    t = R.load_tables(spark, d)
    assert t.edstays.count() == 2 and t.triage.count() == 0 and t.admissions.count() == 0
    assert [r.itemid for r in t.labevents.collect()] == [51221]
    s = R.sample_tables(t, 1)
    assert s.edstays.count() == 1 and [r.subject_id for r in s.patients.collect()] == [1]


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="edc-sink-")
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "stay_id long, split string")
    write_parquet(df, os.path.join(d, "split"), ["split"])
    assert sorted(os.listdir(os.path.join(d, "split")))[-3:] == ["split=test", "split=train", "split=val"]
    back = spark.read.parquet(os.path.join(d, "split"))
    assert back.where("split = 'val'").count() == 1
    write_summary_csv(df, os.path.join(d, "summary"))
    assert len([x for x in os.listdir(os.path.join(d, "summary")) if x.endswith(".csv")]) == 1
    st = write_stage(df, "stage_test")
    assert st.count() == 3 and spark.conf.get("spark.checkpoint.dir") in st.inputFiles()[0].replace("file:", "")
