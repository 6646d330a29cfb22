"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass over the texts: distinct word shingles, their number, a 128-bit
   key of the whole set, and ``COORDS`` MinHash values, each salted with its
   coordinate so that one long stands for a coordinate-value pair.
2. Texts with equal sets form one class (any copies, however many); all
   further work is on classes.
3. Inverted lists: classes are posted under their coordinate-value pairs.
   Pairs held by one class only are skipped; a class with fewer than
   ``MATCHES`` others left has no partner and is skipped whole (skip
   merging). The rest keep their ``m - MATCHES + 1`` rarest pairs: two
   classes with ``MATCHES`` equal coordinates share one of these (prefix
   merging).
4. Candidates from the lists: first each class with the smallest class of its
   list, which collapses most groups of near copies. What is left to ask are
   pairs of different components in one list. Lists of up to ``SHORT_LIST``
   classes give these pairs; longer lists are cut into blocks of
   ``LIST_BLOCK`` classes, and each pair of blocks is compared inside a task,
   which returns only links that join components. So no pairs of a large
   group are ever listed, no task holds more than two blocks, and no link
   that could join two components is lost.
5. Every candidate with ``MATCHES`` equal coordinates is confirmed on the full
   shingle sets (in blocks: on the full sets at once).
6. Components by contraction of the confirmed links.

With Jaccard similarity 0.8 a pair has at least 34 of 64 equal coordinates
with probability over 1 - 1e-6 (binomial tail), so ``MATCHES`` = 34 is a
recall bound, not a cap.

Defined cases: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of fewer words than a shingle is one
shingle; rows with a repeated doc_id are one node, linked through each of their
texts; a row with a null doc_id gets the component of its text's class (null if
no other row has that text) and is not kept; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, id_text
from .components import components
from .shingles import U64, Shingler, mix, odd_multipliers

WIDTH = 5
PERCENT = 80
COORDS = 64
MATCHES = 34
SHORT_LIST = 16
LIST_BLOCK = 1024
#: Columns of the membership matrix that are multiplied at once.
COLUMNS = 2048
#: Shingles hashed at once, so that one very long text needs bounded memory.
CHUNK = 4096


def _signature(sets: np.ndarray, flips: np.ndarray, factors: np.ndarray, salts: np.ndarray) -> np.ndarray:
    best = np.full(len(flips), 2**64 - 1, U64)
    for i in range(0, len(sets), CHUNK):
        part = sets[i:i + CHUNK]
        np.minimum(best, ((part[None, :] ^ flips[:, None]) * factors[:, None]).min(axis=1), out=best)
    return mix(best ^ salts).view(np.int64)


def _set_key(sets: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sets.tobytes())


def signatures(docs: DataFrame, width: int = WIDTH, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), sig."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        rng = np.random.default_rng(7)
        flips = rng.integers(0, 2**64, coords, dtype=U64)
        salts = rng.integers(0, 2**64, coords, dtype=U64)
        factors = odd_multipliers(coords, 13)
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle(text.as_py())
                n.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                sigs.append(_signature(s, flips, factors, salts) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """set_key, shingles (binary: the sorted 64-bit hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])

    return id_text(docs).mapInArrow(run, "set_key binary, shingles binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b, set_a, set_b) whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets: only elements held twice
    count, so they are numbered and multiplied as a 0/1 matrix, by columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[number] > 1
    owner, (_, number) = owner[shared], np.unique(number[shared], return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(number, [a, a + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[lo:hi], number[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _joining(t: pa.Table, percent: int) -> pa.Table:
    """Of one pair of blocks: links (a, b) that join components, no more than
    are needed to join them."""
    cls, comp = t["cls"].to_numpy(), t["comp"].to_numpy()
    a, b = [], []
    if len(np.unique(comp)) > 1:
        sets = [np.frombuffer(x, U64) for x in t["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        both = _overlaps(sets)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(cls[i])
                b.append(cls[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class NearDuplicates:
    """The steps of the module docstring over one documents table."""

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                 coords: int = COORDS, matches: int = MATCHES):
        self.ws = Workspace(spark, "minhash")
        self.docs, self.width, self.percent, self.matches = docs, width, percent, matches
        self.rows = self.ws.put(signatures(docs, width, coords), "rows")

    def classes(self) -> DataFrame:
        """set_key, cls (its smallest doc_id), n, sig, one row per distinct set."""
        c = self.rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        return self.ws.put(c, "classes")

    def prefix_lists(self, classes: DataFrame) -> DataFrame:
        """(v, cls, n): the postings that can find a partner."""
        posted = classes.filter("cls IS NOT NULL").select("cls", "n", F.explode("sig").alias("v"))
        held = posted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = posted.join(held, "v")
        of = Window.partitionBy("cls")
        ranked = shared.select("v", "cls", "n", F.count(F.lit(1)).over(of).alias("m"),
                               F.row_number().over(of.orderBy("df", "v")).alias("rank"))
        # at most COORDS rows per class lie in one window
        return self.ws.put(ranked.filter(f"m >= {self.matches} AND rank <= m - {self.matches} + 1")
                           .select("v", "cls", "n"), "lists")

    def links(self, pairs: DataFrame, classes: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        sig = classes.select("cls", "sig", "n")
        a = sig.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
        b = sig.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
        near = (pairs.distinct().join(a, "a").join(b, "b")
                .filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
                .filter(F.size(F.array_intersect("sig_a", "sig_b")) >= self.matches).select("a", "b").distinct())
        near = self.ws.put(near, f"{name}-candidates")
        p = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
        q = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
        return self.ws.put(_confirmed(near.join(p, "a").join(q, "b"), self.percent).distinct(), f"{name}-links")

    def linked(self, classes: DataFrame) -> DataFrame:
        """(node, root) of the classes that have a link."""
        lists = self.prefix_lists(classes)
        wanted = self.ws.put(classes.select("cls", "set_key").join(lists, "cls", "left_semi"), "wanted")
        texts = id_text(self.docs).join(
            wanted.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = self.ws.put(
            shingle_sets(texts, self.width).join(wanted, "set_key")
            .dropDuplicates(["cls", "set_key"]).select("cls", "shingles"), "sets")
        leads = lists.groupBy("v").agg(F.min("cls").alias("lead"))
        edges = self.links(self._star(lists, leads), classes, sets, "first")
        roots = components(self.ws, edges, "first")
        left = self._open(lists, roots)
        short = self.links(self._across(left.filter(F.col("size") <= SHORT_LIST)), classes, sets, "short")
        long = self.ws.put(self._blocks(left.filter(F.col("size") > SHORT_LIST), sets), "long-links")
        more = short.unionAll(long).unionAll(self._same_id(classes))
        if not more.isEmpty():
            roots = components(self.ws, edges.unionAll(more), "all")
        self.ws.drop("lists", "wanted", "sets", "open", "long-links", "same-id",
                     *(f"{name}-{kind}" for name in ("first", "short") for kind in ("candidates", "links")))
        return roots

    def _same_id(self, classes: DataFrame) -> DataFrame:
        """Links between the classes of one doc_id that stands for several texts."""
        of = self.rows.select("doc_id", "set_key").join(classes.select("set_key", "cls"), "set_key").filter(
            "doc_id IS NOT NULL")
        several = of.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b")
        return self.ws.put(of.join(several.select("doc_id", "a"), "doc_id").filter("cls <> a")
                           .select("a", F.col("cls").alias("b")).distinct(), "same-id")

    @staticmethod
    def _star(lists: DataFrame, leads: DataFrame) -> DataFrame:
        return (lists.join(leads, "v").filter("cls <> lead")
                .select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")))

    def _open(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The postings of lists that hold more than one component, with the
        component and the list's length."""
        seen = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
            "v", "cls", "n", F.coalesce("root", "cls").alias("comp"))
        several = (seen.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                         F.count(F.lit(1)).alias("size")).filter("lo < hi").select("v", "size"))
        return self.ws.put(seen.join(several, "v"), "open")

    def _blocks(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """Links across components in long lists, block by block."""
        percent = self.percent
        n = F.ceil(F.col("size") / F.lit(LIST_BLOCK)).cast("int")
        dealt = lists.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        paired = dealt.select("v", "cls", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                              .alias("other"))
        keyed = paired.select("v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                              "cls", "comp")
        return (keyed.join(sets, "cls").groupBy("v", "p", "q")
                .applyInArrow(lambda t: _joining(t, percent), "a long, b long").distinct())

    def _across(self, lists: DataFrame) -> DataFrame:
        p = lists.select("v", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
        q = lists.select("v", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        return (p.join(q, "v").filter("a < b AND comp_a <> comp_b")
                .filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")).select("a", "b"))

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        classes = self.classes()
        roots = self.linked(classes)
        smallest = roots.groupBy("root").agg(F.min("node").alias("component_id"))
        of_node = roots.join(smallest, "root").select("node", "component_id")
        ids = (classes.select("set_key", "cls").join(of_node, F.col("cls") == F.col("node"), "left")
               .select("set_key", F.coalesce("component_id", "cls").alias("component_id")))
        return (self.rows.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left")
                .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
                .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document, for shingles of
    ``width`` words."""
    return NearDuplicates(spark, docs, width).members()
