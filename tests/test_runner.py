"""End-to-end run with stage tables, the streaming note path, and scan
push-down of the lab item filter."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from helpers import SF_SMALL
from edcohort.plans.runner import run_all
from edcohort.plans.text import prepared_notes
from edcohort.operators.cohort import apply_filters
from edcohort.operators.split import modular_order
from edcohort.sources.fixtures import fixture_tables
from edcohort.sources.readers import scan_labevents
from edcohort.sources.sinks import run_manifest, write_observed
from edcohort.streaming.notes_stream import start_note_stream


def test_run_all_writes_artefacts(spark):
    out = tempfile.mkdtemp(prefix="edc-run-")
    t = fixture_tables(spark, SF_SMALL)
    res = run_all(spark, t, out, order=modular_order())
    for sub in ("labeled_data", "label_summary", "crosstab", "label_correlations", "multimodal",
                "linearized", "manifest"):
        assert os.path.isdir(os.path.join(out, sub)), sub
    n = res["labelled"].count()
    assert n == 882
    assert spark.read.parquet(os.path.join(out, "linearized")).count() == n
    m = spark.read.json(os.path.join(out, "manifest")).collect()[0]
    assert m.n_train + m.n_val + m.n_test == n
    again = run_manifest(res["split"], json.loads(m.config)).collect()[0].asDict()
    assert {k: v for k, v in m.asDict().items()} == {k: v for k, v in again.items() if v is not None}
    loss = spark.read.option("header", True).csv(os.path.join(out, "row_loss")).orderBy("stage_no").collect()
    assert [r.stage for r in loss] == ["stays", "cohort", "labelled", "multimodal", "multimodal_split"]
    assert [int(r.n_rows) for r in loss] == [t.edstays.count(), res["cohort"].count(), n, n, n]


def test_observed_counts_while_writing(spark):
    """Values as an aggregate over the written rows gives them; empty tables
    too, also when Spark proves them empty before the observation."""
    metrics = [F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.count_if(F.col("id") % 3 == 0).alias("thirds")]
    base = spark.range(0, 10_000, 1, 7)
    joined = base.join(base.where("id % 2 = 0"), "id").repartition(5)
    for df in (base, joined, base.where("id < 0"), base.limit(0), joined.where("id > 20000")):
        stage, seen = write_observed(df, "seen", metrics)
        assert seen == stage.agg(*metrics).first().asDict() == df.agg(*metrics).first().asDict()


def test_note_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="edc-stream-")
    t = fixture_tables(spark, SF_SMALL)
    src = os.path.join(d, "src")
    t.notes.write.parquet(src)
    cohort = apply_filters(t).select("subject_id", "hadm_id", "intime", "outtime")
    schema = spark.read.parquet(src).schema
    q = start_note_stream(spark, src, schema, cohort, os.path.join(d, "sink"), name="test_" + os.path.basename(d),
                          trigger_once=True)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(d, "sink"))
    batch = prepared_notes(spark.read.parquet(src), cohort, only_valid=False)
    assert streamed.count() == batch.count() > 0
    assert sorted(r.note_id for r in streamed.collect()) == sorted(r.note_id for r in batch.collect())


def test_lab_item_filter_reaches_scan(spark):
    d = tempfile.mkdtemp(prefix="edc-push-")
    p = os.path.join(d, "labevents")
    spark.createDataFrame([(1, 10, 51221, None, 1.0, "x")],
                          "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, "
                          "valuenum double, valueuom string").write.parquet(p)
    df = scan_labevents(spark.read.parquet(p))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(valuenum), IsNotNull(itemid), In(itemid" in plan or \
           ("PushedFilters" in plan and "In(itemid" in plan)
    narrow = df.select("itemid", "valuenum")._jdf.queryExecution().executedPlan().toString()
    read_schema = narrow.split("ReadSchema:")[1].split("\n")[0]
    assert "valueuom" not in read_schema and "charttime" not in read_schema
