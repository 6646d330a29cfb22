"""Sequence packing, shortest pack first over the length histogram.

Every document is its token ids and an end id, cut into pieces of at most
``MAX_LEN`` (full pieces first, then the rest). Packing works on the histogram
of piece lengths only: lengths are placed longest first, each into the
shortest packs that still have room, whole groups of equal packs at a time, so
the work does not depend on the number of documents. The result is a list of
ranges: of the pieces of one length, those with rank ``lo`` to ``hi`` go to
the sequences from ``base`` on, at ``offset``. Pieces then find their range by
their rank within their length.

Plan: one tokenising pass writes the narrow piece table (no token is
shuffled); the histogram is at most ``MAX_LEN`` rows; ranks are made in two
levels, a row number within (length, hash bucket) plus the sums of the earlier
buckets, so a length held by a third of all pieces is spread over all tasks.
Ranges are sent with the task when they are few (checked, ``SEND_RANGES``);
beyond that they are a table, joined on the length.

Defined cases: a null or empty text is its end id alone; an empty table gives
an empty result; repeated rows and equal documents are packed each by itself
(rows equal in everything are interchangeable); further columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, id_text
from .tokens import WORD_BPE, word_tokenizer

MAX_LEN = 4096
END_ID = 2
SEND_RANGES = 1_000_000


def pieces(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tok.joined(text.as_py()) + end
                n = len(ids) // 4
                for a in range(0, n, max_len):
                    b = min(a + max_len, n)
                    rows.append((doc_id, a, b - a, zlib.crc32(memoryview(ids)[4 * a:4 * b]), n))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Rows (length, lo, hi, base, offset), by length and lo.

    ``groups`` holds runs of sequences with one fill: a heap by fill gives the
    shortest. A run takes one piece per sequence; when fewer pieces are left
    than it has sequences, it is split.
    """
    out, next_seq = [], 0
    groups: list[tuple[int, int, int]] = []  # fill, first sequence, number
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if groups and groups[0][0] + length <= max_len:
                fill, first, size = heapq.heappop(groups)
                if size > left:
                    heapq.heappush(groups, (fill, first + left, size - left))
                    size = left
            else:
                # all open packs are too full: as many new ones as pieces need
                per = max_len // length
                fill, first, size = 0, next_seq, -(-left // per)
                next_seq += size
            out.append((length, rank, rank + size, first, fill))
            rank, left = rank + size, left - size
            if fill + length < max_len:
                heapq.heappush(groups, (fill + length, first, size))
    rows = np.array(out, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``rank``: 0.. within each length, in two levels."""
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = keyed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at"))


def _placed_by_table(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    r = ranges.withColumnRenamed("length", "of_length")
    return rows.join(r, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo"))
                     & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def _placed_in_task(rows: DataFrame, ranges: np.ndarray) -> DataFrame:
    # rank < 2^48 by far: (length, lo) as one sorted key
    keys = (ranges[:, 0] << 48) | ranges[:, 1]
    shift, offset = ranges[:, 3] - ranges[:, 1], ranges[:, 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                 pa.array(rank + shift[at], pa.int64()), pa.array(offset[at], pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                "sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID,
         max_len: int = MAX_LEN, send_ranges: int = SEND_RANGES) -> DataFrame:
    """op6: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    ws = Workspace(spark, "packing")
    rows = ws.put(pieces(docs, tokenizer, end_id, max_len), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most max_len rows
    ranges = pack_histogram(counts, max_len)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked(rows, buckets)
    if len(ranges) <= send_ranges:
        return _placed_in_task(placed, ranges)
    import pandas as pd
    names = ["length", "lo", "hi", "base", "offset"]
    table = spark.createDataFrame(pd.DataFrame(ranges, columns=names))
    return _placed_by_table(placed, ws.put(table, "ranges"))
