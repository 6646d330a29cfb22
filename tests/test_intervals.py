"""Interval joins in time buckets, against brute force and on a hot key."""
import datetime as dt
import random

import pytest
from helpers import SF_SMALL, ts
from pyspark.sql import functions as F

from edcohort.operators import intervals as IV

T0 = dt.datetime(2150, 3, 1)
EVENTS = "k long, e long, t timestamp_ntz"
SPANS = "k long, s long, lo timestamp_ntz, hi timestamp_ntz"


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(4)
    events = [(rnd.choice([1, 1, 1, 2, 3, None]), i, at(rnd.choice([None, 0, 12, 24]) if rnd.random() < .2 else rnd.uniform(-50, 50)))
              for i in range(400)]
    spans = []
    for i in range(60):
        lo = rnd.choice([0.0, 12.0, rnd.uniform(-40, 40)])
        spans.append((rnd.choice([1, 2, 4, None]), i, at(None if i == 7 else lo), at(None if i == 8 else lo + rnd.choice([0, 12, 30, -1]))))
    return events, spans, spark.createDataFrame(events, EVENTS), spark.createDataFrame(spans, SPANS)


@pytest.mark.parametrize("width", [1.0, 12.0, 500.0])
def test_window_join_by_brute_force(sides, width):
    events, spans, e, s = sides
    got = sorted((r.e, r.s) for r in IV.window_join(e, s, ["k"], "t", "lo", "hi", width)
                 .where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).collect())
    want = sorted((i, j) for k, i, t in events for q, j, lo, hi in spans
                  if k is not None and k == q and None not in (t, lo, hi) and lo <= t <= hi)
    assert got == want and len(want) > 50


@pytest.mark.parametrize("width", [1.0, 24.0, 5000.0])
def test_before_join_by_brute_force(sides, width):
    events, spans, e, s = sides
    got = sorted((r.e, r.s) for r in IV.before_join(e, s, ["k"], "t", "hi", width).where(F.col("t") <= F.col("hi")).collect())
    want = sorted((i, j) for k, i, t in events for q, j, _, hi in spans
                  if k is not None and k == q and None not in (t, hi) and t <= hi)
    assert got == want and len(want) > 50


def test_long_history_is_spread(spark):
    """One admission of 10^6 events and 500 stays: no task holds more than a
    few buckets' events, and the spans' copies stay few."""
    n, stays = 1_000_000, 500
    hour = F.lit(T0).cast("timestamp_ntz")
    events = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("e"),
                                   F.timestamp_add("SECOND", F.col("id") * 18, hour).alias("t"))   # 5,000 hours
    spans = spark.range(stays).select(F.lit(1).alias("k"), F.col("id").alias("s"), F.timestamp_add("HOUR", F.col("id") * 10, hour).alias("lo"))
    spans = spans.withColumn("hi", F.timestamp_add("HOUR", F.lit(12), F.col("lo")))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "64", "-1"), strict=True):
            spark.conf.set(c, v)
        joined = IV.window_join(events, spans, ["k"], "t", "lo", "hi", 12.0)
        by_task = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("e").alias("n")).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(by_task) > 40 and max(by_task) < n / 10
    per_stay = joined.groupBy("s").count().agg(F.min("count"), F.max("count")).first()
    assert per_stay[0] >= 2000 and per_stay[1] <= 2402      # 12 h of an event every 18 s, and the pad


@pytest.mark.parametrize("name", ["labs_wide", "labelled_stays", "labs_first_value", "lab_features"])
def test_lab_aggregates_never_sort(spark, name):
    from edcohort.plans.catalog import REGISTRY
    plan = REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_first_values_total_order(spark):
    from edcohort.operators import labs as LS
    rows = [(1, "CBC", 5, 2.0, 9.0), (1, "CBC", 4, 2.0, 8.0), (1, "CBC", 4, 2.0, 7.0), (1, "CBC", 1, 2.5, 1.0),
            (1, "CBC", 0, 0.5, None), (2, "UA", 7, 0.0, None)]
    labs = spark.createDataFrame(rows, "stay_id long, lab_group string, itemid int, hours_from_ed double, valuenum double")
    assert [tuple(r) for r in LS.first_values_long(labs).collect()] == [(1, "CBC", 7.0, 2.0)]
    wide = {r.stay_id: r for r in LS.labs_wide(labs).collect()}
    assert wide[1].lab_CBC_value == 7.0 and wide[1].lab_CBC_time == 2.0 and wide[2].lab_UA_value is None


def test_notes_of_a_stay_with_border_times(spark):
    from edcohort.operators import notes as NO
    stays = spark.createDataFrame([(1, 10, ts("2150-01-01T00:00:00"), ts("2150-01-02T00:00:00"))],
                                  "subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    times = ["2140-01-01T00:00:00", "2150-01-02T00:00:00", "2150-01-02T00:00:01", "2150-01-02T12:00:00"]
    notes = spark.createDataFrame([(i, 1, 10, ts(t)) for i, t in enumerate(times)] + [(9, 1, 10, None), (8, 1, None, ts(times[0]))],
                                  "note_id long, subject_id long, hadm_id long, charttime timestamp_ntz")
    for buffer, want in ((0.0, [0, 1]), (1.0, [0, 1, 2]), (12.0, [0, 1, 2, 3])):
        assert sorted(r.note_id for r in NO.filter_temporal(notes, stays, buffer).collect()) == want
