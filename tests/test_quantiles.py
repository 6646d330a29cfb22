"""Distributed exact quantiles against Spark's percentile and by hand."""
import random

import pytest
from pyspark.sql import functions as F

from edcohort.operators import profile as PR
from edcohort.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def by_percentile(df, by):
    q = F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")
    return {r[0]: r.q for r in df.where("v IS NOT NULL").groupBy(by).agg(q).collect()}


@pytest.mark.parametrize("intervals", [2, 16, 256])
def test_selection_equals_percentile(spark, intervals):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.0, 1.0, rnd.gauss(0, 1e6), rnd.random(), -7.25]))
            for _ in range(3000)] + [("one", 4.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.q for r in Q.selected_quantiles(df, "v", PROBS, ["g"], intervals).collect()}
    assert got == by_percentile(df, "g") and "none" not in got and None in got
    alone = Q.selected_quantiles(df, "v", PROBS, None, intervals).collect()
    assert [r.q for r in alone] == list(by_percentile(df.withColumn("g", F.lit("x")), "g").values())


def test_empty_and_constant(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert Q.selected_quantiles(none, "v", PROBS, ["g"]).collect() == []
    assert [r.q for r in Q.selected_quantiles(none, "v", PROBS).collect()] == [None]
    same = spark.createDataFrame([("a", 3.0)] * 50, "g string, v double")
    assert Q.selected_quantiles(same, "v", PROBS, ["g"]).first().q == [3.0] * len(PROBS)


def test_a_million_distinct_values_in_one_group(spark):
    """No ranked interval holds more than a few shares of the values."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n + F.rand(3) * 0.5).alias("v"))
    df = df.unionAll(df.limit(5).select("g", F.lit(None).cast("double").alias("v")))
    counts = Q.value_frequencies(df, "v", ["g"])
    cuts = counts.agg(F.percentile_approx("__v", [i / 256 for i in range(1, 256)], 2560)).first()[0]
    placed = counts.withColumn("cuts", F.array(*[F.lit(c) for c in cuts])).withColumn("at", Q._interval(F.col("cuts"), 256))
    assert placed.groupBy("at").count().agg(F.max("count")).first()[0] < 4 * n / 256
    assert Q.selected_quantiles(df, "v", PROBS, ["g"]).first().q == by_percentile(df, "g")["g"]


def test_describe_and_box_of_any_domain_equal_the_bounded_way(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.gauss(10, 3) * rnd.choice([1, 1, 1, 9])) for _ in range(2000)], "g string, v double")
    assert sorted(PR.describe(df, ["v"], by="g").collect()) == sorted(PR.describe(df, ["v"], by="g", bounded=True).collect())
    boxes = sorted(PR.box_stats(df, "v", "g").collect())
    assert boxes == sorted(PR.box_stats(df, "v", "g", bounded=True).collect())
    assert sum(r["n"] for r in boxes) == 2000 and all(r.n_outliers > 0 for r in boxes)
