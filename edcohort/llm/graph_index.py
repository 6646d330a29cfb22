"""A robust-pruned directed graph over unit vectors, built and searched in
numpy, many points or queries side by side. One shard at a time; see
``neighbours`` for the job around it."""

from __future__ import annotations

import numpy as np

DEGREE = 32
BUILD_BEAM = 64
SLACK = 1.2
#: Points inserted together, at most; queries searched together.
BATCH = 512
#: Nodes a search opens per step.
OPEN = 4


def _distances(x: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: queries [b, d], ids [b, c]."""
    return 2.0 - 2.0 * np.matmul(x[ids], queries[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``beam`` nearest nodes met (-1: none) and their distances,
    nearest first: open the nearest unopened nodes until all kept are open."""
    b = len(queries)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    opened = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x)), bool)
    ids[:, 0], seen[:, entry] = entry, True
    dist[:, 0] = _distances(x, queries, ids[:, :1])[:, 0]
    live = np.arange(b)
    while len(live):
        closed = ~opened[live] & (ids[live] >= 0)
        pick = closed & (np.cumsum(closed, 1) <= OPEN)
        some = pick.any(1)
        live, pick = live[some], pick[some]
        if not len(live):
            break
        opened[live] |= pick
        nodes = np.full((len(live), OPEN), -1, np.int64)
        at = np.nonzero(pick)
        nodes[at[0], (np.cumsum(pick, 1) - 1)[at]] = ids[live][at]
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        near = np.where((near >= 0) & ~seen[live[:, None], near], near, -1)
        near.sort(axis=1)  # a node reached from two opened ones counts once
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        rows, cols = np.nonzero(near >= 0)
        seen[live[rows], near[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[rows, cols] = 2.0 - 2.0 * np.einsum("nd,nd->n", x[near[rows, cols]], queries[live[rows]])
        all_ids = np.concatenate([ids[live], near], 1)
        all_d = np.concatenate([dist[live], d], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_d, keep, 1)
        ids[live] = np.where(np.isinf(dist[live]), -1, ids[live])
        opened[live] = np.take_along_axis(all_open, keep, 1)
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Out-edges [b, degree] (-1: none): nearest first; a candidate goes when
    an edge already taken is nearer to it, by the slack, than the point is."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == points[:, None]] = -1
    to_point = np.where(c >= 0, _distances(x, x[points], c), np.inf)
    vectors = x[c]
    between = 2.0 - 2.0 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int64)
    rows, square = np.arange(len(points)), slack * slack
    left = to_point.copy()
    for k in range(degree):
        j = left.argmin(1)
        ok = np.isfinite(left[rows, j])
        if not ok.any():
            break
        out[:, k] = np.where(ok, c[rows, j], -1)
        left[square * between[rows, j] <= to_point] = np.inf
        left[rows, j] = np.inf
    return out


def _add_reverse(x: np.ndarray, graph: np.ndarray, points: np.ndarray, edges: np.ndarray, slack: float) -> None:
    """For every new edge p -> q also q -> p; lists grown too long are pruned."""
    degree = graph.shape[1]
    rows, cols = np.nonzero(edges >= 0)
    target, source = edges[rows, cols], points[rows]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    by_size = np.argsort(count, kind="stable")
    for a in range(0, len(nodes), BATCH):
        some = by_size[a:a + BATCH]
        width = int(count[some].max())
        place = np.arange(width)
        at = np.minimum(first[some][:, None] + place, len(source) - 1)
        new = np.where(place < count[some][:, None], source[at], -1)
        both = np.concatenate([graph[nodes[some]], new], 1)
        full = (both >= 0).sum(1) > degree
        room = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]
        graph[nodes[some][~full]] = room
        step = max(1, 200_000 // (both.shape[1] ** 2) * 16)
        crowded = np.flatnonzero(full)
        for s in range(0, len(crowded), step):
            part = crowded[s:s + step]
            graph[nodes[some][part]] = robust_prune(x, nodes[some][part], both[part], degree, slack)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK,
          seed: int = 3) -> tuple[np.ndarray, int]:
    """(graph [n, degree] with -1 for no edge, entry node) of unit vectors."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int((x @ x.mean(0)).argmax()) if n else 0
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int64) if n else order
    at, size = 1, 1
    while at < n:
        points = order[at:at + size]
        found, _ = beam_search(x, graph, x[points], entry, beam)
        mates = np.broadcast_to(points, (len(points), len(points)))[:, :64]  # of the same batch
        candidates = np.concatenate([found, mates], 1)
        edges = robust_prune(x, points, candidates, degree, slack)
        graph[points] = edges
        _add_reverse(x, graph, points, edges, slack)
        at += size
        size = min(2 * size, BATCH)
    return graph, entry
