"""Interval joins in time buckets.

An equi join on the admission key with a time range as residual brings all
events of one admission into one task, and compares each with every stay of it.
Here the time axis is cut into buckets and the bucket joins the key, so the
events of a long history are spread over tasks and meet only the spans that
reach into their bucket:

* ``window_join``: bounded spans. A span is copied into each bucket it touches;
  with buckets as wide as the longest span these are two (three at a border).
* ``before_join``: no lower bound. A span is copied into the buckets that really
  hold events of its key up to its end. Each copy but the last yields a match,
  so the copies are never more than the result and the spans together.

Every event lies in exactly one bucket, so no pair is found twice. Null keys and
null times match nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import MICROS_PER_HOUR, add_hours, micros_between

_BUCKET = "__bucket"
#: Spans are widened by this for the choice of buckets only, so that rounding
#: in the caller's exact test never loses a border event.
_PAD_HOURS = 1.0 / 3600.0
NOTE_BUCKET_HOURS = 24.0


def time_bucket(t: Column, width_hours: float) -> Column:
    """Number of the bucket of ``t`` (grows with ``t``)."""
    epoch = F.lit(dt.datetime(1970, 1, 1)).cast(T.TimestampNTZType())
    return F.floor(micros_between(epoch, t) / F.lit(width_hours * MICROS_PER_HOUR)).cast("long")


def window_join(events: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str,
                width_hours: float) -> DataFrame:
    """``events`` with the ``spans`` of equal ``keys`` for which ``at`` lies in
    ``start`` to ``end`` (both included, give or take a second: callers test
    their own border exactly)."""
    lo, hi = add_hours(start, -_PAD_HOURS), add_hours(end, _PAD_HOURS)
    copies = (spans.where(F.col(start).isNotNull() & (F.col(start) <= F.col(end)))
              .withColumn(_BUCKET, F.explode(F.sequence(time_bucket(lo, width_hours), time_bucket(hi, width_hours)))))
    placed = events.where(F.col(at).isNotNull()).withColumn(_BUCKET, time_bucket(F.col(at), width_hours))
    return (placed.join(copies, [*keys, _BUCKET]).where((F.col(at) >= lo) & (F.col(at) <= hi)).drop(_BUCKET))


def before_join(events: DataFrame, spans: DataFrame, keys: list[str], at: str, end: str,
                width_hours: float = NOTE_BUCKET_HOURS) -> DataFrame:
    """``events`` with the ``spans`` of equal ``keys`` for which ``at`` is not
    after ``end`` (give or take a second, as above)."""
    hi = add_hours(end, _PAD_HOURS)
    placed = events.where(F.col(at).isNotNull()).withColumn(_BUCKET, time_bucket(F.col(at), width_hours))
    held = placed.select(*keys, _BUCKET).distinct()
    copies = (spans.where(F.col(end).isNotNull()).join(held, keys)
              .where(F.col(_BUCKET) <= time_bucket(hi, width_hours)))
    return placed.join(copies, [*keys, _BUCKET]).where(F.col(at) <= hi).drop(_BUCKET)
