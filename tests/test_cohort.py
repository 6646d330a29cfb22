"""Cohort filters and derivations on hand-written frames (edges included)."""
from pyspark.sql import functions as F

from helpers import ts
from edcohort.operators import cohort as C
from edcohort.sources.readers import Tables

STAYS = "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz"
PATS = "subject_id long, gender string, anchor_age int, anchor_year int"
ADM = "subject_id long, hadm_id long, hospital_expire_flag int"
TRI = ("stay_id long, temperature double, heartrate double, resprate double, o2sat double, sbp double, "
       "dbp double, acuity double, pain string, chiefcomplaint string")


def _tables(spark, stays, pats, adm=None, tri=None):
    return Tables(edstays=spark.createDataFrame(stays, STAYS), patients=spark.createDataFrame(pats, PATS),
                  admissions=spark.createDataFrame(adm or [], ADM),
                  triage=spark.createDataFrame(tri or [], TRI))


def full_triage(sid, n_present=7):
    vals = [37.0, 80.0, 16.0, 98.0, 120.0, 80.0, 3.0]
    return (sid, *[v if i < n_present else None for i, v in enumerate(vals)], "5", "pain|x")


def test_los_edges_and_flags(spark):
    base = "2020-01-01T00:00:00"
    stays = [(1, 1, 11, ts(base), ts("2020-01-01T00:00:00")),   # LOS 0
             (2, 1, 12, ts(base), ts("2020-01-02T00:00:00")),   # LOS 24
             (3, 1, 13, ts(base), ts("2020-01-08T00:00:00")),   # LOS 168
             (4, 1, 14, ts(base), ts("2020-01-08T00:00:01")),   # just over 168
             (5, 1, 15, ts(base), ts("2019-12-31T23:00:00"))]   # negative
    t = _tables(spark, stays, [(1, "M", 40, 2020)], [(1, h, f) for h, f in
                                                    [(11, None), (12, 1), (13, 0), (14, 0), (15, 0)]],
                [full_triage(i) for i in range(1, 6)])
    out = {r.stay_id: r for r in C.apply_filters(t).collect()}
    assert out[1].ed_los_hours == 0.0 and out[1].lengthened_ed_stay == 0
    assert out[2].ed_los_hours == 24.0 and out[2].lengthened_ed_stay == 0
    assert out[3].ed_los_hours == 168.0
    assert out[4].ed_los_hours is None and out[4].lengthened_ed_stay == 0
    assert out[5].ed_los_hours is None
    assert out[1].hospital_death == 0 and out[2].hospital_death == 1


def test_age_filter_edges(spark):
    d = ts("2020-06-01T00:00:00")
    stays = [(i, i, 100 + i, d, d) for i in range(1, 6)]
    pats = [(1, "F", 17, 2020), (2, "F", 18, 2020), (3, "M", 120, 2020), (4, "M", 121, 2020), (5, "M", None, 2020)]
    t = _tables(spark, stays, pats, [(i, 100 + i, 0) for i in range(1, 6)], [full_triage(i) for i in range(1, 6)])
    kept = sorted(r.stay_id for r in C.apply_filters(t).collect())
    assert kept == [2, 3]


def test_age_uses_visit_year(spark):
    stays = [(1, 1, 101, ts("2025-03-01T00:00:00"), ts("2025-03-01T05:00:00"))]
    t = _tables(spark, stays, [(1, "M", 16, 2022)], [(1, 101, 0)], [full_triage(1)])
    r = C.apply_filters(t).collect()[0]
    assert r.age_at_ed == 19 and r.age_group == "18-30"


def test_triage_completeness(spark):
    d = ts("2020-01-01T00:00:00")
    stays = [(1, 1, 101, d, d), (2, 1, 102, d, d)]
    t = _tables(spark, stays, [(1, "M", 40, 2020)], [(1, 101, 0), (1, 102, 0)],
                [full_triage(1, 4), full_triage(2, 5)])
    assert [r.stay_id for r in C.apply_filters(t).collect()] == [2]


def test_missing_columns(spark):
    d = ts("2020-01-01T00:00:00")
    stays = spark.createDataFrame([(1, 1, 101, d, d)], STAYS)
    pats = spark.createDataFrame([(1, 30)], "subject_id long, anchor_age int")   # no gender, no anchor_year
    tri = spark.createDataFrame([(1, 37.0, 80.0)], "stay_id long, temperature double, heartrate double")
    out = C.apply_filters(Tables(edstays=stays, patients=pats, triage=tri)).collect()[0]
    assert out.gender == "U" and out.age_at_ed == 30
    assert out.triage_completeness == 2          # min(5, 2 fields present) = 2


def test_age_bands(spark):
    ages = [18, 30, 31, 60, 61, 90, 91, 120, 0, 121]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = [r.b for r in df.select(C.age_band(F.col("age")).alias("b")).collect()]
    assert got == ["18-30", "18-30", "31-60", "31-60", "61-90", "61-90", "90+", "90+", None, None]


def test_funnel_monotone_and_matches_filters(spark):
    from edcohort.sources.fixtures import fixture_tables
    from helpers import SF_SMALL
    t = fixture_tables(spark, SF_SMALL)
    rows = [r.n_rows for r in C.cohort_funnel(t).orderBy("step_no").collect()]
    assert rows == sorted(rows, reverse=True)
    assert rows == [1500, 1007, 955, 882]
    assert C.apply_filters(t).count() == rows[-1]


def test_zscores_constant_and_single(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 30.0)], "stay_id long, temperature double, heartrate double")
    out = {r.stay_id: r for r in C.vital_zscores(df).transform(C.vital_risk_score).collect()}
    assert out[1].temperature_zscore is None and out[1].temperature_abnormal == 0
    one = spark.createDataFrame([(1, 5.0)], "stay_id long, sbp double")
    r = C.vital_zscores(one).collect()[0]
    assert r.sbp_zscore is None and r.sbp_abnormal == 0


def test_temporal_features(spark):
    from edcohort.functions.timecols import temporal_features
    df = spark.createDataFrame([(1, ts("2024-01-06T21:00:00")), (2, ts("2024-01-08T12:00:00"))],
                               "stay_id long, intime timestamp_ntz")
    out = {r.stay_id: r for r in temporal_features(df).collect()}
    assert (out[1].day_of_week, out[1].is_weekend, out[1].is_night) == (5, 1, 1)   # Saturday
    assert (out[2].day_of_week, out[2].is_weekend, out[2].is_night) == (0, 0, 0)   # Monday noon
