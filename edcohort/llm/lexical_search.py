"""Ranked lexical search, reversed: the documents stream past the items.

The items are few and the documents many, so the items' terms are the inverted
index: term -> (item, occurrences in the item). Every task holds it, streams its
documents' term counts through it, adds each document's scores up item by item
and keeps the ``k`` best documents per item in a bounded heap. The heaps of all
tasks are merged by a row number per item.

Terms are the maximal runs of ASCII letters, digits and characters beyond
ASCII, with A-Z in lower case. With N documents that have a term, L terms in
them, n terms in one document, df documents holding a term and tf occurrences
in the document, a term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))`` and a
document scores the sum over the item's terms, repeats included, of
``weight * ((10^9 tf) div (1000 tf + 8 m))``, m = 100 - B + (B n N) div L.

Plan: items are cut into blocks of ``block_bytes`` of text (by hash, checked,
cut finer while a block is over the bound and more than one item), so what is
sent to the tasks is at most the bound or one single item. Per block one pass
over the texts writes each document's length and its counts of the block's
terms (narrow, no shuffle); N, L and df are aggregates of that table with
map-side sums; the second pass reads the narrow table only. Rows out of a task
are at most k times the items.

Defined cases: a null or empty text, or one without terms, is no document (not
counted, never found) and no item with results; an empty table on either side
gives an empty result; repeated rows of documents are documents of their own,
so an id can stand twice; equal rows of items are one item, different texts
under one item_id are ranked each by itself; null doc_ids come last among equal
scores; fewer than k hits give fewer rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, id_text

TOP = 10
#: Weight of the document length, in percent.
LENGTH_PERCENT = 75
#: Bytes of item texts per block: bounds index and postings in every task.
BLOCK_BYTES = 4 << 20
NO_ID = 1 << 63
#: Byte map: separators to a space, A-Z to lower case.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

_FOUND = "item long, item_id long, doc_id long, score long"


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (raw or b"").translate(_FOLD).split()


class Index:
    """Postings of one block of items. ``item_ids`` by item number."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        counts = [Counter(terms(raw)) for _, raw in items]
        self.item_ids = [item_id for item_id, _ in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
        posts = sorted((self.vocabulary[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        table = np.array(posts, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))
        self.items, self.repeats = table[:, 1], table[:, 2]

    def scores(self, of: np.ndarray, tf: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
        """Every item's score for a document with ``tf`` of the terms ``of``."""
        gain = weights[of] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        n = self.first[of + 1] - self.first[of]
        at = np.arange(n.sum()) + np.repeat(self.first[of] - (np.cumsum(n) - n), n)
        out = np.zeros(len(self.item_ids), np.int64)
        np.add.at(out, self.items[at], self.repeats[at] * np.repeat(gain, n))
        return out


class Best:
    """The ``k`` best (score, smaller doc_id first) per item."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # what a document must reach

    def add(self, scores: np.ndarray, doc_id: int) -> None:
        for i in np.flatnonzero(scores >= self.least):
            heap, entry = self.heaps[i], (int(scores[i]), -doc_id)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, heap in enumerate(self.heaps):
            yield from ((i, score, -minus) for score, minus in heap)


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the numbers and counts of the terms of
    ``vocabulary``, for every document that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, of, tf = [], [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(),
                                   batch.column("text").cast(pa.binary()), strict=True):
                found = terms(raw.as_py())
                if not found:
                    continue
                held = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                ids.append(doc_id)
                lengths.append(len(found))
                of.append([t for t, _ in held])
                tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(of, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tf"])

    return id_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def best_per_task(counts: DataFrame, index: Index, weights: np.ndarray, n_docs: int, n_terms: int,
                  k: int, percent: int) -> DataFrame:
    """Each task's heaps: item (number), item_id, doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(index.item_ids), k)
        for batch in batches:
            of_all, tf_all = batch.column("terms"), batch.column("tf")
            for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                                batch.column("n").to_pylist(), strict=True)):
                of, tf = of_all[i].values.to_numpy(), tf_all[i].values.to_numpy()
                if len(of):
                    m = 100 - percent + percent * n * n_docs // n_terms
                    best.add(index.scores(of, tf, weights, m), NO_ID if doc_id is None else doc_id)
        rows = list(best.rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()),
             pa.array([index.item_ids[r[0]] for r in rows], pa.int64()),
             pa.array([None if r[2] == NO_ID else r[2] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.int64())], ["item", "item_id", "doc_id", "score"])

    return counts.mapInArrow(run, _FOUND)


def _search_block(spark: SparkSession, ws: Workspace, docs: DataFrame, items: list, name: str,
                  k: int, percent: int) -> DataFrame:
    index = Index(items)
    counts = ws.put(term_counts(docs, index.vocabulary), f"{name}-counts")
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    held = (counts.select(F.explode("terms").alias("term")).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df")).collect())  # at most the block's terms
    weights = np.zeros(len(index.vocabulary), np.int64)
    for r in held:
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    found = best_per_task(counts, index, weights, total["n"], total["l"] or 1, k, percent)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = ws.put(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), name)
    ws.drop(f"{name}-counts")
    return out


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct (item_id, text as ``raw``, ``block``) and the number of blocks:
    no block of more than one item is over ``block_bytes``."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.col("text").cast("string").cast("binary").alias("raw")).filter("raw IS NOT NULL").distinct()
    blocks = 1
    while True:
        cut = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)))
        over = (cut.groupBy("block").agg(F.sum(F.octet_length("raw")).alias("size"), F.count(F.lit(1)).alias("n"))
                .filter((F.col("size") > block_bytes) & (F.col("n") > 1)))
        if over.isEmpty():
            return cut, blocks
        blocks *= 2


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP,
           percent: int = LENGTH_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """op11: item_id, rank, doc_id, score: each item's ``k`` best documents."""
    ws = Workspace(spark, "lexical")
    cut, blocks = item_blocks(items, block_bytes)
    out = []
    for b in range(blocks):
        held = sorted(((r["item_id"], bytes(r["raw"])) for r in cut.filter(F.col("block") == b).collect()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if held:
            out.append(_search_block(spark, ws, docs, held, f"block-{b}", k, percent))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, out or [empty])


SQL = r"""
WITH d AS (
  SELECT row, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY row, doc_id, term),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
m AS (SELECT row, 25 + (75 * n * n_docs) // n_terms AS m FROM lengths, total),
scores AS (
  SELECT q.item_id, tf.row, tf.doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf ON q.term = tf.term JOIN weights ON weights.term = tf.term JOIN m ON m.row = tf.row
  GROUP BY q.item_id, tf.row, tf.doc_id),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
