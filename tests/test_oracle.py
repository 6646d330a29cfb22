"""SQL oracle at sf 0.001: Spark result equals the DuckDB result."""
import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from helpers import SF_SMALL

PICK = ["cohort_full", "cohort_funnel", "labs_wide", "labelled_stays", "label_correlations", "notes_temporal_hybrid",
        "segment_text", "top_keywords", "note_concat", "stratified_split", "training_examples", "histogram",
        "box_stats", "run_manifest"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "orders", "lineitem", "documents", "part", "events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", PICK)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, cur.fetchall())
