"""Profiling reports on hand-written frames (edges: constant column,
maximum in the last bin, outliers, absent columns, empty input)."""
import statistics

from edcohort.operators import profile as PR


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r.bin: r for r in PR.histogram(df, "x", bins=5).collect()}
    assert len(h) == 5 and sum(r.n for r in h.values()) == 5
    assert h[5].n == 1 and h[5].bin_hi == 10.0            # the maximum lands in the last bin
    assert h[1].n == 2 and h[2].n == 2                    # [0,2) and [2,4)
    const = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    hc = {r.bin: r for r in PR.histogram(const, "x", bins=2).collect()}
    assert hc[1].bin_lo == 6.5 and hc[2].bin_hi == 7.5 and hc[2].n == 2


def test_box_stats_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", float(v)) for v in vals], "g string, v double")
    r = PR.box_stats(df, "v", "g").collect()[0]
    q1, q3 = 3.0, 7.0
    assert (r.q1, r.median, r.q3) == (q1, 5.0, q3)
    assert r.whisker_lo == 1.0 and r.whisker_hi == 8.0 and r.n_outliers == 1


def test_describe_grouped_matches_python(spark):
    data = {"x": [1.0, 2.0, 4.0, 8.0, 16.0], "y": [3.0, 3.0, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    out = {r.g: r for r in PR.describe(df, ["v"], by="g").collect()}
    for g, vs in data.items():
        r = out[g]
        assert r["count"] == len(vs) and abs(r["mean"] - statistics.mean(vs)) < 1e-6
        assert abs(r["std"] - statistics.stdev(vs)) < 1e-6
        qs = statistics.quantiles(vs, n=4, method="inclusive")
        assert abs(r.p25 - qs[0]) < 1e-6 and abs(r.p50 - qs[1]) < 1e-6 and abs(r.p75 - qs[2]) < 1e-6


def test_completeness_and_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "b")], "id int, s string")
    c = {r.column: r for r in PR.completeness(df, ["id", "s"], expected=["gone"]).collect()}
    assert c["s"].non_null == 2 and c["s"].missing == 1 and c["gone"].present is False
    vc = {r.s: (r.n, r.share) for r in PR.value_counts(df, "s", normalize=True).collect()}
    assert vc == {"b": (2, 1.0)}
    inv = {r.table: (r.n_rows, r.n_columns) for r in PR.table_inventory({"t": df}).collect()}
    assert inv == {"t": (3, 2)}


def test_empty_input_rates_are_null(spark):
    df = spark.createDataFrame([], "subject_id long, gender string, age_at_ed int, ed_los_hours double, "
                                   "lengthened_ed_stay int, hospital_death int")
    r = PR.cohort_summary(df).collect()[0]
    assert r.n_rows == 0 and r.pct_male is None and r.los_median is None
