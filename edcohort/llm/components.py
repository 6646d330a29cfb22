"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): nodes share a root
    exactly when a path joins them; the root is one of them.

    Every round sends each node to its smallest neighbour or itself and keeps
    the edges between the images; every node that is not a local minimum
    merges, so rounds are few. Rounds are written tables: nothing is held on
    the driver, and a lost executor costs part of one round.
    """
    maps = []
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    live = ws.put(live, f"{name}-edges-0")
    while not live.isEmpty():
        k = len(maps)
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = ws.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
                    .withColumnRenamed("a", "node"), f"{name}-map-{k}")
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = ws.put(live.join(left, "a").join(right, "b")
                      .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                      .filter("a < b").distinct(), f"{name}-edges-{k + 1}")
    if not maps:
        return ws.spark.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        hop = step.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(hop, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = ws.put(out, f"{name}-roots")
    ws.drop(*(f"{name}-{kind}-{k}" for k in range(len(maps) + 1) for kind in ("map", "edges")))
    return roots
