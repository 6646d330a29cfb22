"""Lab window, first-value picks, pivot and time costs."""
from helpers import ts
from edcohort.operators import labs as LS
from edcohort.sources.labdim import lab_dim, item_to_group

STAYS = "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz"
LABS = "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double"


def test_item_in_two_groups_goes_to_last():
    g = item_to_group()
    assert g[50931] == "BLOOD_GAS" and g[50983] == "BLOOD_GAS" and g[50971] == "BLOOD_GAS"
    assert len(g) == 56


def test_window_edges_ties_and_fanout(spark):
    t0 = "2020-01-01T00:00:00"
    stays = spark.createDataFrame([(1, 1, 20000000, ts(t0)), (2, 1, 20000000, ts("2020-01-01T06:00:00")),
                                   (3, 1, 20000001, ts(t0))], STAYS)
    labs = spark.createDataFrame([
        (1, 20000000, 51221, ts("2020-01-01T00:00:00"), 40.0),   # 0 h for stay 1
        (1, 20000000, 51222, ts("2020-01-01T00:00:00"), 12.0),   # same time, other CBC item
        (1, 20000000, 51300, ts("2020-01-01T12:00:00"), 7.0),    # 12 h: inside for stay 1
        (1, 20000000, 51300, ts("2020-01-01T12:00:01"), 8.0),    # just outside for stay 1
        (1, 20000000, 50931, ts("2019-12-31T23:59:59"), 99.0),   # before arrival
        (1, 20000000, 50931, ts("2020-01-01T07:00:00"), None),   # null value dropped
        (1, 20000001, 50931, ts("2020-01-01T01:00:00"), 5.5),    # other admission
    ], LABS)
    dim = lab_dim(spark)
    prepared = LS.prepare_labs(labs, stays, dim)
    counts = {r.stay_id: r["count"] for r in prepared.groupBy("stay_id").count().collect()}
    assert counts == {1: 3, 2: 2, 3: 1}    # shared admission fans out; stay 2 window starts at 6 h
    wide = {r.stay_id: r for r in LS.labs_wide(prepared).collect()}
    assert wide[1].lab_CBC_value == 40.0 and wide[1].lab_CBC_time == 0.0   # tie broken by item id
    assert wide[3].lab_BLOOD_GAS_value == 5.5 and wide[3].lab_CHEM_value is None
    assert wide[2].lab_CBC_time == 6.0


def test_mean_variant(spark):
    stays = spark.createDataFrame([(1, 1, 10, ts("2020-01-01T00:00:00"))], STAYS)
    labs = spark.createDataFrame([(1, 10, 51221, ts("2020-01-01T01:00:00"), 2.0),
                                  (1, 10, 51222, ts("2020-01-01T02:00:00"), 4.0)], LABS)
    p = LS.prepare_labs(labs, stays, lab_dim(spark))
    r = LS.labs_wide(p, use_first=False).collect()[0]
    assert r.lab_CBC_value == 3.0 and r.lab_CBC_time == 1.0


def test_time_costs_order_and_zero_los(spark):
    from edcohort.sources.labdim import LAB_GROUPS
    cols = {f"lab_{g}_ordered": 0 for g in LAB_GROUPS}
    rows = []
    for i, chosen in enumerate([[], ["CBC"], ["CBC", "INFLAM", "UA"]]):
        r = dict(cols, stay_id=i, ed_los_hours=0.0 if i == 1 else 10.0)
        for g in chosen:
            r[f"lab_{g}_ordered"] = 1
        rows.append(r)
    df = LS.lab_time_costs(spark.createDataFrame(rows))
    out = {r.stay_id: r for r in df.collect()}
    assert out[0].lab_time_cost_sequential == 0 and out[0].lab_time_cost_parallel == 0
    assert out[1].lab_time_pct_of_los is None           # LOS 0 as divisor → null
    r = out[2]
    assert r.lab_time_cost_sequential == 248 and r.lab_time_cost_parallel == 178
    assert r.lab_time_cost_parallel <= r.lab_time_cost_mixed <= r.lab_time_cost_sequential
    assert abs(r.lab_time_cost_mixed - (0.7 * 178 + 0.3 * 248)) < 1e-9


def test_items_missing(spark):
    d = spark.createDataFrame([(i,) for i in item_to_group() if i not in (50386, 50931)], "itemid int")
    out = {r.lab_group: r.missing_itemids for r in LS.lab_items_missing(d).collect()}
    assert out == {"TOX": "50386", "CHEM": "50931", "BLOOD_GAS": "50931"}


def test_unknown_group(spark):
    labs = spark.createDataFrame([(99999,), (51221,)], "itemid int")
    out = {r.itemid: (r.lab_group, r.group_minutes)
           for r in LS.assign_lab_groups(labs, lab_dim(spark), keep_unknown=True).collect()}
    assert out == {99999: ("UNKNOWN", 0), 51221: ("CBC", 30)}


def test_fused_events_equal_separate_operators(spark):
    from helpers import SF_SMALL
    from edcohort.operators import labels as LB
    from edcohort.operators.cohort import apply_filters
    from edcohort.plans.tabular import cohort_keys, featured_stays, labelled_stays
    from edcohort.sources.fixtures import fixture_tables
    t = fixture_tables(spark, SF_SMALL)
    cohort = apply_filters(t)
    fused = labelled_stays(t, cohort=cohort)
    apart = LB.create_all_labels(featured_stays(t, cohort=cohort), t.icustays, keys=cohort_keys(cohort))
    cols = sorted(fused.columns)
    assert cols == sorted(apart.columns)
    a = sorted(tuple(r) for r in fused.select(*cols).collect())
    b = sorted(tuple(r) for r in apart.select(*cols).collect())
    assert a == b and len(a) == 882


def test_top_groups(spark):
    labs = spark.createDataFrame([(g,) for g in "AAABBCCDEF"], "lab_group string")
    assert [tuple(r) for r in LS.top_groups(labs).collect()] == [
        ("A", 3, 30.0), ("B", 2, 20.0), ("C", 2, 20.0), ("D", 1, 10.0), ("E", 1, 10.0)]
    assert LS.top_groups(labs.limit(0)).collect() == []


def test_features_and_labels_need_their_keys(spark):
    import pytest
    from edcohort.operators import labels as LB
    lacking = spark.createDataFrame([(1,)], "stay_id long")
    with pytest.raises(ValueError, match="subject_id"):
        LS.extract_lab_features(lacking, None)
    with pytest.raises(ValueError, match="subject_id"):
        LB.create_all_labels(lacking, None)
