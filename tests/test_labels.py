"""Outcome labels: death fallbacks, ICU existence, lengthened stay."""
from helpers import ts
from edcohort.operators import labels as LB


def test_icu_two_rows_one_flag(spark):
    stays = spark.createDataFrame([(1, 1, 10, ts("2020-01-01T00:00:00"), ts("2020-01-01T10:00:00")),
                                   (2, 2, 20, ts("2020-01-01T00:00:00"), ts("2020-01-01T10:00:00"))],
                                  "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    icu = spark.createDataFrame([(1, 10, ts("2020-01-01T10:00:00")), (1, 10, ts("2020-01-01T22:00:00")),
                                 (2, 20, ts("2020-01-01T22:00:01")), (2, 20, ts("2020-01-01T09:59:59"))],
                                "subject_id long, hadm_id long, intime timestamp_ntz")
    out = LB.icu_transfer(stays, icu).collect()
    assert len(out) == 2
    assert {r.stay_id: r.icu_transfer_12h for r in out} == {1: 1, 2: 0}


def test_death_fallbacks(spark):
    flag = spark.createDataFrame([(1, None), (2, 1)], "stay_id long, hospital_expire_flag int")
    assert [r.hospital_death for r in LB.hospital_death(flag).orderBy("stay_id").collect()] == [0, 1]
    dt = spark.createDataFrame([(1, None), (2, ts("2020-01-01T00:00:00"))], "stay_id long, deathtime timestamp_ntz")
    assert [r.hospital_death for r in LB.hospital_death(dt).orderBy("stay_id").collect()] == [0, 1]
    d = "2020-01-10T12:00:00"
    rows = [(i, ts(d), ts(f"2020-01-{10 + off:02d}T12:00:00")) for i, off in enumerate([-1, 0, 1, 2, 3])]
    rows.append((9, ts(d), None))
    dod = spark.createDataFrame(rows, "stay_id long, dischtime timestamp_ntz, dod timestamp_ntz")
    got = [r.hospital_death for r in LB.hospital_death(dod).orderBy("stay_id").collect()]
    assert got == [1, 1, 1, 0, 0, 0]
    none = spark.createDataFrame([(1,)], "stay_id long")
    assert LB.hospital_death(none).collect()[0].hospital_death == 0


def test_lengthened_fallback_unclamped(spark):
    df = spark.createDataFrame([(1, ts("2020-01-01T00:00:00"), ts("2020-01-20T00:00:00")),
                                (2, ts("2020-01-01T00:00:00"), None)],
                               "stay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    out = {r.stay_id: r.lengthened_ed_stay for r in LB.lengthened_stay(df).collect()}
    assert out == {1: 1, 2: 0}


def test_crosstab_margins(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 0), (0, 0)], "critical_outcome int, lengthened_ed_stay int")
    out = {(r.critical_outcome, r.lengthened_ed_stay): r.n for r in LB.crosstab_margins(df).collect()}
    assert out[("All", "All")] == 4 and out[("0", "0")] == 2 and out[("1", "All")] == 2 and out[("All", "1")] == 1
    norm = {(r.critical_outcome, r.lengthened_ed_stay): r.pct_of_col for r in LB.crosstab_normalized(df).collect()}
    assert abs(norm[(0, 0)] - 66.666667) < 1e-6 and norm[(1, 1)] == 100.0
