"""Small frame helpers shared by the operators (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, rows: list[tuple], names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Turn a (usually one-row) aggregate into long form.

    ``rows`` is a list of tuples of Columns/literals, one tuple per output
    row; ``names`` names the tuple positions. ``keep`` columns are carried.
    """
    structs = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n)
                          for v, n in zip(r, names)]) for r in rows]
    return df.select(*(keep or []), F.inline(F.array(*structs)))


def r6(c: Column | str) -> Column:
    """Round a computed double to 6 places (for cross-engine comparison)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def melt(df: DataFrame, cols: list[str], keep: list[str] | None = None,
         name: str = "feature", value: str = "x") -> DataFrame:
    """Unpivot ``cols`` (cast to double) into (name, value) rows, carrying
    ``keep``. Used before per-feature statistics so the aggregate stays narrow
    (a few buffers per group) instead of hundreds of columns wide; partial
    aggregation collapses the multiplied rows inside each task."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*(keep or []), F.inline(pairs))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that yields null for a zero divisor (ANSI mode would raise)."""
    a = F.col(num) if isinstance(num, str) else num
    b = F.col(den) if isinstance(den, str) else den
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    """100·num/den (multiplied first, like ``x * 100.0 / n`` in SQL), null
    for a zero divisor."""
    a = F.col(num) if isinstance(num, str) else num
    return safe_div(a.cast("double") * F.lit(100.0), den)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both sides are present, as
    sample covariance over the product of sample deviations. A constant side
    gives null (Spark's ``corr`` divides by zero under ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))
