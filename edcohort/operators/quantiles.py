"""Exact quantiles.

Two ways, same result (linear interpolation, as Spark's ``percentile``):

* bounded domain (lengths in characters, hours of stays in whole seconds,
  counts): one aggregate by (group, value) with map-side partial counts leaves
  as many rows as there are distinct values; ``percentile`` takes these counts
  as frequencies.
* any domain: distributed selection. The (group, value) counts are cut into
  ``INTERVALS`` intervals by a sketch of the distinct values (a scalar, the same
  cuts for every group), so no interval holds more than its share of the
  distinct values, whatever the groups are. Sums per (group, interval) show
  which intervals hold a wanted rank; only their values are ranked, each
  interval by itself, and the wanted ones read off. The sketch only decides how
  even the intervals are, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of the distributed selection (a power of two).
INTERVALS = 256


def _probs(probs: list[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def value_frequencies(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by`` columns, ``__v`` (double, not null) and its count ``__k``."""
    return (df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
            .groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__k")))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Bounded domain. One row per non-empty group: ``by`` columns + ``q`` (array
    of the quantiles in ``probs`` order). Without ``by``: one row, null if empty."""
    by = list(by or [])
    counts = value_frequencies(df, value, by)
    q = F.percentile("__v", _probs(probs), F.col("__k")).alias("q")
    return counts.groupBy(*by).agg(q) if by else counts.agg(q)


def _interval(cuts: Column, n: int) -> Column:
    """How many of the ``n - 1`` sorted ``cuts`` lie below ``__v``."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(int(math.log2(n))))])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(cuts, at + s - 1) < F.col("__v"), s).otherwise(0))


def selected_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                       intervals: int = INTERVALS) -> DataFrame:
    """Any domain; rows as ``exact_quantiles``."""
    by = list(by or [])
    counts = value_frequencies(df, value, by)
    cuts = counts.agg(F.percentile_approx("__v", _probs([i / intervals for i in range(1, intervals)]),
                                          10 * intervals).alias("c")).scalar()
    placed = counts.withColumn("__cuts", cuts).withColumn("__at", _interval(F.col("__cuts"), intervals)).drop("__cuts")
    # at most ``intervals`` rows per group
    sizes = placed.groupBy(*by, "__at").agg(F.sum("__k").alias("__n"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = group.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
                               "__total": F.sum("__n").over(group)})

    def place(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    ends = [end(place(p)).cast("long") for p in probs for end in (F.floor, F.ceil)]
    wanted = [(F.col("__before") <= e) & (e < F.col("__before") + F.col("__n")) for e in ends]
    hit = wanted[0]
    for w in wanted[1:]:
        hit = hit | w
    hits = sizes.where(hit).select(*[F.col(c).alias(f"__h_{c}") for c in by], F.col("__at").alias("__h_at"),
                                   "__before", "__total")
    same = F.col("__at") == F.col("__h_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
    inside = placed.join(hits, same)
    up_to = Window.partitionBy(*by, "__at").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__last", F.col("__before") + F.sum("__k").over(up_to) - 1)
    first = F.col("__last") - F.col("__k") + 1
    terms = []
    for j, p in enumerate(probs):
        for name, end in (("lo", F.floor), ("hi", F.ceil)):
            e = end(place(p)).cast("long")
            terms.append(F.max(F.when((first <= e) & (e <= F.col("__last")), F.col("__v"))).alias(f"__{name}{j}"))
    read = inside.groupBy(*by).agg(F.max("__total").alias("__total"), *terms)
    out = []
    for j, p in enumerate(probs):
        lo, hi, at = F.col(f"__lo{j}"), F.col(f"__hi{j}"), place(p)
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return read.select(*by, F.when(F.col("__total").isNotNull(), F.array(*out)).alias("q"))


def quantile_frame(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                   exact: bool = True, bounded: bool = True) -> DataFrame:
    """``by`` columns + ``q`` array: exact (``bounded`` says whether the values
    have a bounded domain) or a fixed-size sketch (``percentile_approx``) per
    group."""
    if exact:
        return (exact_quantiles if bounded else selected_quantiles)(df, value, probs, by)
    q = F.percentile_approx(F.col(value).cast("double"), _probs(probs), 10000)
    return df.groupBy(*by).agg(q.alias("q")) if by else df.agg(q.alias("q"))


def global_quantiles(df: DataFrame, value: str, probs: list[float], exact: bool = True,
                     bounded: bool = True) -> Column:
    """The quantile array as a scalar subquery column (no join; null when
    there is no value)."""
    return quantile_frame(df, value, probs, None, exact, bounded).select("q").scalar()
