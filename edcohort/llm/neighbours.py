"""Nearest neighbours by cosine over sharded robust-pruned graphs.

1. Rows whose vector is null, zero, or holds null or non-finite components take
   no part. Equal vectors become one node; of its rows the ``k + 1`` smallest
   ids are kept (a query needs ``k`` besides its own), counted in two levels so
   a vector shared by a third of all rows meets no single task.
2. Nodes are dealt by hash to shards of about ``SHARD_ROWS``; each shard's graph
   is built by greedy searches that propose neighbours and robust pruning.
3. Queries (ids divisible by ``every``) form blocks; every block searches every
   shard by beam search. A task takes some shards, one after another, and some
   blocks, at most ``TASK_BLOCKS``; tasks form a grid of shards by blocks and
   read their two sides where they lie, so no copies of blocks or shards are
   shuffled or broadcast.
4. All nodes a beam search returns are scored by the cosine of the original
   vectors in double precision, rounded to ``DIGITS``, and the best ``k + 1``
   by score and smallest id stay. Graph and beam cannot tell near copies apart:
   where the whole beam lies within float32 error of the last place, one of the
   best has an edge that short, or nodes were out of reach of an unfilled beam,
   the query is compared with all vectors of the shard instead.
5. Per query the best nodes of all shards are merged by the same order, first
   within tasks, opened into their ids, and ranked.

The number of searches is queries times shards, as the method has it; each
touches a few thousand of a shard's vectors. Shards and blocks are bounded,
and nothing of them passes through the driver.

Recall against brute force is over 0.99 on the given tables (see README).

Defined cases: fewer rows than ``k`` give all of them; ties go to the smaller
vec_id; rows with a repeated vec_id are all candidates of other ids, none of
their own id, and as queries they give one answer per distinct vector; vectors
of another length than the query's are no candidates for it: every length has
shards, query blocks and answers of its own; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph_index as graph
from .common import Workspace

K = 5
EVERY = 50
SHARD_ROWS = 8192
QUERY_ROWS = 2048
#: Query blocks a search task holds, at most.
TASK_BLOCKS = 16
#: Shards staged in one file, at most.
FILE_SHARDS = 4
BEAM = 160
#: Of a score that count: further ones are rounding.
DIGITS = 14
#: Bound of the float32 error of a squared distance.
FLOAT_ERROR = 1e-5
NODE = "k1 long, k2 long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec array<double>, its length ``width``, k1, k2 (128 bits of the
    vector)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    # abs(x) < infinity is false for NaN, which is larger than all numbers here
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
                       & F.exists("vec", lambda x: x != 0.0))
    return rows.withColumns({"width": F.size("vec"), "k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return _directions(x).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; large components are scaled first."""
    if not len(a):
        return np.zeros(0)
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) if np.abs(v).max() > 1e100 or np.abs(v).max(axis=1).min() < 1e-100
            else v for v in (a, b))
    return np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))


def shard_graphs(nodes: DataFrame) -> DataFrame:
    """One row per shard: keys, smallest ids, whether a node has that id alone,
    vectors, graph, entry."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k1", "ascending"), ("k2", "ascending")]).combine_chunks()
        x = _matrix(t["vec"].chunk(0), t.num_rows)
        g, entry = graph.build(_unit(x))
        return pa.table({"width": t["width"].slice(0, 1), "shard": t["shard"].slice(0, 1), "k1": [t["k1"].to_pylist()], "k2": [t["k2"].to_pylist()],
                         "least": [t["vec_id"].to_pylist()], "alone": [t["alone"].to_pylist()], "vectors": [x.tobytes()], "graph": [g.astype("<i4").tobytes()],
                         "entry": pa.array([entry], pa.int32())})

    return nodes.groupBy("width", "shard").applyInArrow(
        run, "width int, shard int, k1 array<long>, k2 array<long>, least array<long>, alone array<boolean>, "
             "vectors binary, graph binary, entry int")


def query_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of queries of one length. ``rows`` carry the number of ``blocks``
    of their length."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("k1", "ascending"), ("k2", "ascending")]).combine_chunks()
        return pa.table({"width": t["width"].slice(0, 1), "block": t["block"].slice(0, 1),
                         "queries": [t["vec_id"].to_pylist()], "q1": [t["k1"].to_pylist()], "q2": [t["k2"].to_pylist()],
                         "wanted": [_matrix(t["vec"].chunk(0), t.num_rows).tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "k1"), "blocks").cast("int"))
    return dealt.select("width", "block", "vec_id", "k1", "k2", "vec").groupBy("width", "block").applyInArrow(
        run, "width int, block int, queries array<long>, q1 array<long>, q2 array<long>, wanted binary")


def search_pairs(graphs: DataFrame, asked: DataFrame, shards: int, blocks: int, tasks: int) -> DataFrame:
    """Every shard with every block of its length, in about ``tasks`` tasks. A
    join by key would copy every block to every shard, through a shuffle or, as
    Spark judges by the size before the copies, a broadcast."""
    per_task = min(TASK_BLOCKS, math.ceil(blocks / math.ceil(math.sqrt(tasks))))
    columns = math.ceil(blocks / per_task)
    lanes = min(shards, math.ceil(tasks / columns))
    asked = asked.repartitionByRange(columns, "width", "block")
    return graphs.coalesce(lanes).hint("shuffle_replicate_nl").join(asked, "width")


def _best(score: np.ndarray, least: np.ndarray, best: int) -> np.ndarray:
    """Places [b, best] of the best nodes: by score, then smallest id."""
    return np.lexsort((np.broadcast_to(least, score.shape), -np.round(score, DIGITS)), axis=1)[:, :best]


def _crowded(unit: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Nodes with an edge to a near copy."""
    out = np.zeros(len(unit), bool)
    for k in range(g.shape[1]):
        short = 2.0 - 2.0 * np.einsum("nd,nd->n", unit, unit[g[:, k]]) <= FLOAT_ERROR
        out |= short & (g[:, k] >= 0)
    return out


def _nearest_in_shard(unit: np.ndarray, x: np.ndarray, g: np.ndarray, entry: int, least: np.ndarray,
                      crowded: np.ndarray, unit_q: np.ndarray, q: np.ndarray, own: np.ndarray, best: int,
                      beam: int) -> np.ndarray:
    """[b, best] nodes (-1: none) per query; ``own`` [b, nodes] are those that
    hold nothing but the query's id."""
    found, dist = graph.beam_search(unit, g, unit_q, entry, beam)
    full = found[:, -1] >= 0
    tight = np.where(full, dist[:, -1] <= dist[:, min(best, beam) - 1] + FLOAT_ERROR, (found >= 0).sum(1) < len(x))
    tight |= (crowded[found] & (found >= 0))[:, :best].any(1)
    found = np.where(np.take_along_axis(own, np.maximum(found, 0), 1), -1, found)
    tight |= (found >= 0).sum(1) < np.minimum(best, len(x) - own.sum(1))
    at = np.nonzero(found >= 0)
    score = np.full(found.shape, -np.inf)
    score[at] = _cosines(q[at[0]], x[found[at]])
    out = np.take_along_axis(found, _best(score, least[found], best), 1)
    if tight.any():
        all_scores = np.where(own[tight], -np.inf, _directions(q[tight]) @ _directions(x).T)
        near = _best(all_scores, least, best)
        near = np.where(np.take_along_axis(own[tight], near, 1), -1, near)
        out[tight] = np.pad(near, ((0, 0), (0, out.shape[1] - near.shape[1])), constant_values=-1)
    return out


def _leading(who: np.ndarray, node: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Places of the rows that can be among the ``best`` of their query ``who``
    by rounded score and ``node`` [3, n] (smallest id, keys), however scores are
    rounded: only equal ones, and those a round-off apart, are told by more."""
    if not len(who):
        return np.zeros(0, np.int64)
    order = np.lexsort((node[2], node[1], node[0], -score, who))
    who, score = who[order], score[order]
    place = np.arange(len(order))
    query = np.append(True, who[1:] != who[:-1])
    equal = query | np.append(True, score[1:] != score[:-1])
    last = np.minimum(np.maximum.accumulate(np.where(query, place, 0)) + best - 1, len(order) - 1)
    floor = np.where(who[last] == who, score[last], -np.inf) - 2 * 10.0 ** -DIGITS
    return order[(score >= floor) & (place - np.maximum.accumulate(np.where(equal, place, 0)) < best)]


def _search(pairs: DataFrame, best: int, beam: int) -> DataFrame:
    """query_id, q1, q2, k1, k2, least, score: the ``best`` nodes per query, of
    all shards that a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, blocks = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)

                def longs(name: str, row: pa.RecordBatch = row) -> np.ndarray:
                    return np.array(row.column(name).flatten(), np.int64)

                width, shard, block = (row.column(c)[0].as_py() for c in ("width", "shard", "block"))
                if met != (width, shard):
                    met = width, shard
                    nodes = np.array([longs("least"), longs("k1"), longs("k2")])
                    alone = np.array(row.column("alone").flatten().to_pylist(), bool)
                    x = np.frombuffer(row.column("vectors")[0].as_py()).reshape(nodes.shape[1], -1)
                    g = np.frombuffer(row.column("graph")[0].as_py(), "<i4").reshape(len(x), -1).astype(np.int64)
                    entry, unit = row.column("entry")[0].as_py(), _unit(x)
                    crowded = _crowded(unit, g)
                if (width, block) not in blocks:
                    blocks[width, block] = (np.array([longs("queries"), longs("q1"), longs("q2")]),
                                            np.zeros(0, np.int64), np.zeros((3, 0), np.int64), np.zeros(0))
                asker, *held = blocks[width, block]
                q = np.frombuffer(row.column("wanted")[0].as_py()).reshape(asker.shape[1], -1)
                unit_q, parts = _unit(q), [held]
                for a in range(0, len(q), graph.BATCH):
                    some = slice(a, a + graph.BATCH)
                    found = _nearest_in_shard(unit, x, g, entry, nodes[0], crowded, unit_q[some], q[some],
                                              alone & (nodes[0] == asker[0, some, None]), best, beam)
                    at = np.nonzero(found >= 0)
                    node, who = found[at], at[0] + a
                    parts.append((who, nodes[:, node], _cosines(q[who], x[node])))
                who, node, score = (np.concatenate(c, -1) for c in zip(*parts, strict=True))
                keep = _leading(who, node, score, best)
                blocks[width, block] = asker, who[keep], node[:, keep], score[keep]
        for asker, who, node, score in blocks.values():
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, asker[:, who]), pa.array(node[1]), pa.array(node[2]), pa.array(node[0]), pa.array(score)],
                ["query_id", "q1", "q2", "k1", "k2", "least", "score"])

    return pairs.mapInArrow(run, f"query_id long, q1 long, q2 long, {NODE}, least long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = BEAM) -> DataFrame:
    """op9: query_id, rank, vec_id, score."""
    ws = Workspace(spark, "neighbours")
    rows = ws.put(usable(vectors), "rows")

    # the k + 1 smallest ids of every distinct vector, first within parts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("k1", "k2", "vec_id", F.pmod(F.hash("vec_id"), F.lit(parts)).alias("part")).distinct()
    some = Window.partitionBy("k1", "k2", "part").orderBy("vec_id")
    whole = Window.partitionBy("k1", "k2").orderBy("vec_id")
    ids = ids.withColumn("n", F.row_number().over(some)).filter(F.col("n") <= k + 1)
    ids = ids.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= k + 1)
    ids = ws.put(ids.select("k1", "k2", "vec_id", "n"), "ids")

    first = ids.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), (F.count(F.lit(1)) == 1).alias("alone"))
    nodes = rows.join(first, ["k1", "k2", "vec_id"]).dropDuplicates(["k1", "k2"])
    asking = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "k1", "k2"])

    def parts_of(n: Column, size: int) -> Column:
        return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")

    # one row per length: how many shards and query blocks it has
    widths = nodes.groupBy("width").agg(parts_of(F.count(F.lit(1)), shard_rows).alias("shards"))
    asked_of = asking.groupBy("width").agg(parts_of(F.count(F.lit(1)), query_rows).alias("blocks"))
    widths = ws.put(widths.join(asked_of, "width", "left"), "widths")
    nodes = nodes.join(widths, "width").withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), "shards").cast("int"))
    graphs = ws.put(shard_graphs(nodes.select("width", "shard", "k1", "k2", "vec_id", "alone", "vec")), "graphs",
                    FILE_SHARDS)
    asked = query_blocks(asking.join(widths, "width"))
    shards, blocks = (n or 1 for n in widths.agg(F.sum("shards"), F.sum("blocks")).first())
    found = ws.put(_search(search_pairs(graphs, asked, shards, blocks, parts), k + 1, beam), "found")
    ws.drop("rows", "graphs")

    asker = ["query_id", "q1", "q2"]
    best = Window.partitionBy(*asker).orderBy(F.round("score", DIGITS).desc(), "least", "k1", "k2")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n", "least")
    opened = top.join(ids.drop("n"), ["k1", "k2"]).filter("vec_id <> query_id")
    order = Window.partitionBy(*asker).orderBy(F.round("score", DIGITS).desc(), "vec_id")
    return (opened.select(*asker, "vec_id", "score").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
