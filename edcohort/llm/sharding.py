"""Sharding by longest-processing-time scheduling.

Groups that must stay together (rows with one key; equal texts in the query)
go, largest first, to the least loaded shard, taken from a heap. The law is
``bytes``: shard sizes come as near to each other as whole groups allow. A
group larger than an even share has a shard to itself and sets the maximum; it
is not cut.

The heap works on the histogram of group sizes: of ``n`` groups of one size,
once the loads lie within that size, every full round gives each shard one
more, so rounds are counted instead of walked. k different sizes need at least
k^2 / 2 bytes of input, so the histogram has at most sqrt(2 * bytes) rows (14
million at 100 TB), however many groups there are; it streams, sorted, through
one task that holds only the heap. Its result are ranges: of the groups of a
size, those ranked ``lo`` to ``hi`` go to one shard.

Plan: rows -> (key, size, ...) staged as a narrow table -> groups by key
(map-side sums, so a group of a third of all rows is one row per task) ->
histogram -> ranges. Groups get their rank within their size in two levels
(hash bucket, then row number), meet the ranges per (size, bucket), and rows
get their group's shard by a join on the key. Keys that hold more than one
``HEAVY``-th of all rows (so fewer than HEAVY keys) are joined by broadcast
instead, where rows stay in place. Slots within a shard are numbered in two
levels as well, by buckets of the row, not of the group.

Defined cases: a null and an empty text have no bytes (size 8, checksum 0) and
are one group; rows with a repeated doc_id, or equal rows, are rows of their
own with slots of their own; null doc_ids are numbered like others; an empty
table gives an empty result; equal sizes are ordered by bucket and key, so the
result depends on the rows alone; further columns are not read (``write_shards``
keeps them).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, id_text

SHARDS = 24
#: Bytes counted for a row beside its text.
ROW_BYTES = 8
#: Buckets of the two-level numberings.
BUCKETS = 4096
#: Keys with more than this part of all rows are joined by broadcast.
HEAVY = 1000


class Loads:
    """The heap of (load, shard), fed one size after another, largest first."""

    def __init__(self, shards: int):
        self.heap = [(0, s) for s in range(shards)]

    def place(self, size: int, n: int) -> list[tuple[int, int]]:
        """(shard, number) of the ``n`` groups of ``size`` that go to each shard."""
        took: dict[int, int] = {}
        while n:
            if n >= len(self.heap) and max(self.heap)[0] - self.heap[0][0] <= size:
                rounds = n // len(self.heap)
                self.heap = [(load + rounds * size, s) for load, s in self.heap]  # order is kept
                for _, s in self.heap:
                    took[s] = took.get(s, 0) + rounds
                n -= rounds * len(self.heap)
                continue
            load, s = heapq.heappop(self.heap)
            # as many as keep it the least loaded, one at least
            many = min(n, (self.heap[0][0] - load) // max(size, 1) + 1) if self.heap else n
            heapq.heappush(self.heap, (load + many * size, s))
            took[s] = took.get(s, 0) + many
            n -= many
        return sorted(took.items())


def ranges(histogram: DataFrame, shards: int) -> DataFrame:
    """size, lo, hi, shard from (size, n): one task over the sorted histogram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = Loads(shards)
        for batch in batches:
            out = []
            for size, n in zip(batch.column("size").to_pylist(), batch.column("n").to_pylist(), strict=True):
                lo = 0
                for shard, many in loads.place(size, n):
                    out.append((size, lo, lo + many, shard))
                    lo += many
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["size", "lo", "hi", "shard"])

    ordered = histogram.select("size", "n").repartition(1).sortWithinPartitions(F.desc("size"))
    return ordered.mapInArrow(run, "size long, lo long, hi long, shard long")


def _before(sizes: DataFrame, by: str) -> DataFrame:
    """``sizes`` (by, bucket, n) with the sum of the earlier buckets' n."""
    earlier = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def group_shards(ws: Workspace, groups: DataFrame, shards: int) -> DataFrame:
    """key, n_rows, shard from the staged groups (key, size, n_rows, bucket)."""
    counts = groups.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = ws.put(counts, "counts")
    cuts = ws.put(ranges(counts.groupBy("size").agg(F.sum("n").alias("n")), shards), "ranges")
    places = _before(counts, "size").withColumnRenamed("size", "of_size")
    met = (places.join(cuts, (F.col("of_size") == F.col("size"))
                       & (F.col("lo") < F.col("before") + F.col("n")) & (F.col("hi") > F.col("before")))
           .groupBy("of_size", F.col("bucket").alias("of_bucket"), "before")
           .agg(F.collect_list(F.struct("hi", "shard")).alias("cuts")))  # at most one per shard
    within = Window.partitionBy("size", "bucket").orderBy("key")
    ranked = groups.withColumn("at", F.row_number().over(within) - 1)
    rank = F.col("before") + F.col("at")
    shard = F.array_min(F.filter("cuts", lambda c: c["hi"] > rank))["shard"]
    return (ranked.join(met, (F.col("size") == F.col("of_size")) & (F.col("bucket") == F.col("of_bucket")))
            .select("key", "n_rows", shard.cast("int").alias("shard")))


def assign(spark: SparkSession, rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (key binary, size long, tie long, item struct) with ``shard`` and
    ``slot``. Rows of one key share a shard; slots are gapless from 0 in each
    shard, and rows equal in key and tie are interchangeable."""
    ws = Workspace(spark, "sharding")
    rows = ws.put(rows.select("key", "size", "tie", "item"), "rows")
    groups = (rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
              .withColumn("bucket", _bucket("key")))
    placed = ws.put(group_shards(ws, ws.put(groups, "groups"), shards), "placed")
    heavy_rows = max(placed.agg(F.sum("n_rows")).first()[0] or 0, HEAVY) // HEAVY
    heavy = placed.filter(F.col("n_rows") > heavy_rows).select("key", "shard")
    light = placed.filter(F.col("n_rows") <= heavy_rows).select("key", "shard")
    few = F.broadcast(heavy)  # fewer than HEAVY rows, since each holds more than a HEAVY-th of all
    found = rows.join(few, "key").unionByName(rows.join(few, "key", "left_anti").join(light, "key"))
    found = ws.put(found.select("item", "key", "tie", "shard", _bucket("key", "tie").alias("bucket")), "found")
    numbers = _before(found.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "shard").drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("key", "tie")
    numbered = found.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(numbers), ["shard", "bucket"]).select(  # shards * BUCKETS rows at most
        "item", "shard", (F.col("before") + F.col("at")).alias("slot"))


def _keyed(text: Column) -> list[Column]:
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return [F.unhex(F.md5(raw)).alias("key"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size")]


def shard_report(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """op12: doc_id, size, text_crc32, law, shard, slot, grown_shard per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_text(docs).select(*_keyed(F.col("text")), "doc_id", F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    rows = rows.select("key", "size", F.col("doc_id").alias("tie"), F.struct("doc_id", "size", "crc").alias("item"))
    return assign(spark, rows, shards).select(
        F.col("item.doc_id").alias("doc_id"), F.col("item.size").alias("size"),
        F.col("item.crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole rows of ``docs`` as Parquet folders ``shard=0 ...``, with ``slot``
    beside a struct ``doc`` of all columns (so no name can clash)."""
    rows = docs.select(*_keyed(F.col("text").cast("string")), F.col("doc_id").cast("long").alias("tie"),
                       F.struct("*").alias("item"))
    (assign(spark, rows, shards).select(F.col("item").alias("doc"), "slot", "shard")
     .write.mode("error").partitionBy("shard").parquet(path))
