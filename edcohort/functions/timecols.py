"""Time helpers (F9–F11). All are built-in expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_MINUTE = 60_000_000.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: str | Column) -> Column:
    """parse to a zone-less timestamp; unparsable text becomes null.

    Timestamp columns pass through; strings go through ``try_cast``.
    """
    return _col(c).try_cast(T.TimestampNTZType())


def parse_number(c: str | Column) -> Column:
    """Numeric coercion, bad values become null (never NaN)."""
    return _col(c).try_cast(T.DoubleType())


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in fractional hours."""
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_MINUTE)


def add_hours(ts: str | Column, hours: float | Column) -> Column:
    """timestamp + hours (fractional hours allowed)."""
    h = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_add("MICROSECOND", (h * F.lit(MICROS_PER_HOUR)).cast("long"), _col(ts))


def temporal_features(df: DataFrame, ts: str = "intime") -> DataFrame:
    """hour of day, day of week (Monday = 0), weekend, night."""
    if ts not in df.columns:
        return df
    t = parse_timestamp(F.col(ts))
    hour = F.hour(t)
    dow = F.weekday(t)
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": dow,
        "is_weekend": F.coalesce(dow >= 5, F.lit(False)).cast("int"),
        "is_night": F.coalesce((hour >= 20) | (hour <= 6), F.lit(False)).cast("int"),
    })
