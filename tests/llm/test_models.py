"""Perplexity, language identification and nearest neighbours."""
import collections
import math

import numpy as np
import pytest
from llm_helpers import SF, rows

from edcohort.llm import graph_index, language_id, neighbours, perplexity, queries


# ------------------------------------------------------------- perplexity

def brute_model(words_, order):
    """Interpolated modified Kneser-Ney by its definition, over dicts."""
    s, e = perplexity.START, perplexity.END
    top = collections.Counter()
    for w in words_:
        t = s + w + e
        for j in range(1, len(t)):
            top[t[max(0, j - order + 1):j + 1]] += 1
    levels = {order: {g: c for g, c in top.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        levels[k] = dict(collections.Counter(g[1:] for g in levels[k + 1]))
        if k > 1:
            levels[k] |= {g: c for g, c in top.items() if len(g) == k}
    cuts = {k: perplexity.discounts([sum(c == i for c in lv.values()) for i in (1, 2, 3, 4)])
            for k, lv in levels.items()}
    size = len(levels[1]) + 1

    def cut(k, c):
        return cuts[k][min(c, 3) - 1]

    def p(ctx, ch):
        k = len(ctx) + 1
        lower = 1.0 / size if k == 1 else p(ctx[1:], ch)
        seen = {g: c for g, c in levels[k].items() if g[:-1] == ctx}
        total = sum(seen.values())
        if not total:
            return lower
        back = sum(cut(k, c) for c in seen.values()) / total
        c = seen.get(ctx + ch, 0)
        return (max(c - cut(k, c), 0) / total if c else 0.0) + back * lower

    def cost(w):
        t = s + w + e
        return -sum(math.log(p(t[max(0, j - order + 1):j], t[j])) for j in range(1, len(t))), len(t) - 1

    return cost


@pytest.mark.parametrize("order", [1, 3, 5])
def test_perplexity_by_definition(spark, order):
    good = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog met the other cat", "then the log met"]
    docs = [(i, t, "en") for i, t in enumerate(good * 3)] + [(100, "the zebra quacks", "en"), (101, "XXX ### the", "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    train = [r.text for r in perplexity.trusted_rows(frame, labels).filter(perplexity._fold(frame.doc_id) > 0).collect()]
    cost = brute_model([w for t in train for w in t.split()], order)
    for entries in (10**6, 40):
        got = {r.doc_id: r for r in perplexity.perplexities(spark, frame, labels, order, entries).collect()}
        for i, text, _ in docs:
            parts = [cost(w) for w in text.split()]
            total, n = (sum(x) for x in zip(*parts, strict=True))
            assert got[i].n_chars == n
            assert got[i].perplexity == pytest.approx(math.exp(total / n), rel=1e-5), (entries, text)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_trusted_texts_by_masks(spark, limit):
    ids = [-130, -64, -1, 0, 1, 63, 64, 65, 127, 128, 2**40, 2**63 - 1, -2**63, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(64, "again")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, 1, None) for i in (-130, -1, 0, 63, 64, 64, 128, 2**63 - 1, -2**63, None, 5)]
        + [(65, 0, 0), (1, 1, 1), (127, None, 0)], "doc_id long, quality int, toxic int")
    ws = perplexity.Workspace(spark, "test-masks")
    got = perplexity.trusted_texts(ws, docs, labels, limit).collect()
    want = perplexity.trusted_rows(docs, labels).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 9


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r.kept for r in perplexity.judge(spark, docs, labels).collect()}
    by = {q: [out[r.doc_id] for r in labels.filter(f"quality = {q}").collect() if r.doc_id in out] for q in (0, 1)}
    assert np.mean(by[1]) > 0.99 and np.mean(by[0]) < 0.3


def test_repeated_and_shuffled_clean_words_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = [r for r in docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").collect()
             if len(r.text.split()) > 200][:30]
    rnd, made = np.random.default_rng(4), []
    for i, r in enumerate(clean):
        ws = r.text.split()
        made.append((10**9 + i, " ".join(rnd.permutation(ws)), r.lang))
        made.append((2 * 10**9 + i, " ".join([ws[i]] * 300), r.lang))
        made.append((3 * 10**9 + i, r.text, r.lang))
    more = docs.select("doc_id", "text", "lang").unionAll(
        spark.createDataFrame(made, "doc_id long, text string, lang string"))
    out = perplexity.judge(spark, more, labels).filter("doc_id >= 1000000000").collect()
    kept = {k: np.mean([r.kept for r in out if r.doc_id // 10**9 == k]) for k in (1, 2, 3)}
    assert kept[3] > 0.95 and kept[2] < 0.05 and kept[1] < 0.7, kept


def test_perplexity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (20, 1, None), (None, 1, 0), (60, None, 0)],
                                   "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert perplexity.quality_report(spark, empty, labels).collect() == []
    out = perplexity.quality_report(spark, edge, labels).collect()
    assert {r.doc_id for r in out if r.perplexity is None} == {30, 40, 50}
    assert not any(r.kept for r in out if r.perplexity is None)
    untrained = perplexity.quality_report(spark, edge, none).collect()
    assert all(r.kept == (r.n_chars > 0) for r in untrained)
    left = perplexity.keep_good(spark, edge, none)
    assert left.columns == edge.columns and left.count() == len(rows()) - 3


# ------------------------------------------------------------- language id

def test_gradients_by_differences():
    net = language_id.Network(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n = language_id.padded([b"abc", b"d", b"hello"])
    y = np.array([0, 1, 2])
    grads, _ = net.gradients(x, n, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = net.w[k][at], 1e-4
        net.w[k][at] = old + step
        up = net.gradients(x, n, y)[1]
        net.w[k][at] = old - step
        down = net.gradients(x, n, y)[1]
        net.w[k][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], abs=2e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op8_language_id"](spark, sf).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert 0.2 < len(held) / len(out) < 0.3
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, edge, empty):
    assert language_id.language_report(empty).collect() == []
    out = language_id.language_report(edge).collect()
    assert len(out) == len(rows())
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {30, 40, 50, 180} <= und and 0 not in und
    assert all((r.score == 0) == (r.lang_pred == "und") for r in out)
    unlabelled = language_id.language_report(edge.withColumn("lang", edge.lang.substr(99, 1)).filter("false")).collect()
    assert unlabelled == []


# ------------------------------------------------------ nearest neighbours

def brute_nearest(ids, x, every=50, k=5):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i] / (norm * norm[i])
        keep = np.flatnonzero(ids != ids[i])
        order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_on_the_tables(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    want = brute_nearest(t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64))
    got = answers(queries.QUERIES["op9_neighbours"](spark, "/root/testdata/sf0.01"))
    assert set(got) == set(want)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert np.mean(hits) / 5 > 0.97
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[v]) < 1e-12 for v, s in got[q] if v in scores)


def test_sharded_search_merges_all_shards(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16))
    ids = np.arange(1500) * 5
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)],
                                  "vec_id long, embedding array<double>")
    got, want = answers(neighbours.nearest(spark, frame, shard_rows=400, query_rows=50)), brute_nearest(ids, x)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]) / 5 > 0.97


def test_neighbours_in_tight_groups_and_scaled_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(32)
    tight = base + 3e-4 * rng.standard_normal((1200, 32))
    x = np.concatenate([tight, rng.standard_normal((300, 32))])
    ids = rng.permutation(1500) * 5
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)],
                                  "vec_id long, embedding array<double>")
    got, want = answers(neighbours.nearest(spark, frame, shard_rows=800, query_rows=50)), brute_nearest(ids, x)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]) / 5 > 0.99
    v = rng.standard_normal(8)
    scaled = spark.createDataFrame([(i, (v * (i + 1)).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(spark, scaled, shard_rows=150))
    assert all([v for v, _ in got[q]] == [i for i in range(6) if i != q][:5] for q in range(0, 400, 50))


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [2.0, 0.0]), (50, [0.0, 1.0]), (8, [0.0, -1.0]),
            (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (350, []),
            (400, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in data],
                                  "vec_id long, embedding array<double>, k1 string, rank int")
    got = answers(neighbours.nearest(spark, frame))
    assert set(got) == {0, 50}
    assert [v for v, _ in got[0]] == [3, 7, 9, 8, 50]
    assert [v for v, _ in got[50]] == [0, 3, 7, 9, 8]
    assert [round(s, 12) for _, s in got[0]] == [1, 1, 1, 0, 0]
    many = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(400)] + [(1001, [4.0, 3.0])],
                                 "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(spark, many))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[100]] == [0, 1, 2, 3, 4]
    assert neighbours.nearest(spark, frame.limit(0)).collect() == []
    assert neighbours.nearest(spark, frame.filter("vec_id = 8")).collect() == []
    assert neighbours.nearest(spark, frame.filter("vec_id = 50")).collect() == []


def test_graph_of_few_points():
    x = np.eye(3, dtype=np.float32)
    g, entry = graph_index.build(x)
    ids, _ = graph_index.beam_search(x, g, x, entry, 8)
    assert [set(r[r >= 0].tolist()) for r in ids] == [{0, 1, 2}] * 3 and ids[:, 0].tolist() == [0, 1, 2]


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(6)
    x2, x3 = rng.standard_normal((600, 2)), rng.standard_normal((200, 3))
    i2, i3 = np.arange(600) * 25, 20_000 + np.arange(200) * 25
    rows = [(int(i), v.tolist()) for i, v in [*zip(i2, x2, strict=True), *zip(i3, x3, strict=True)]]
    frame = spark.createDataFrame(rows + [(7, [1.0] * 9)], "vec_id long, embedding array<double>").repartition(5)
    got = answers(neighbours.nearest(spark, frame, shard_rows=150, query_rows=64))
    want = brute_nearest(i2, x2) | brute_nearest(i3, x3)
    assert set(got) == set(want) and len(got) == 400
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]) / 5 > 0.97


def test_a_query_id_with_two_vectors_gets_two_answers(spark):
    data = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0])] + [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1, 8)]
    out = neighbours.nearest(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["rank"] for r in out) == sorted(list(range(1, 6)) * 2)
    near = lambda axis: sorted(range(1, 8), key=lambda i: -(np.cos(i) if axis == 0 else np.sin(i)))[:5]
    assert sorted(r.vec_id for r in out) == sorted(near(0) + near(1))


def broadcast_bytes(plan):
    """Data size of all broadcasts of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return broadcast_bytes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return broadcast_bytes(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "BroadcastExchange" else 0
    children = plan.children()
    return own + sum(broadcast_bytes(children.apply(i)) for i in range(children.size()))


def test_query_blocks_are_not_copied_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((600, 64)), np.arange(600) * 25
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)],
                                  "vec_id long, embedding array<double>")
    search, sent = neighbours._search, []

    def watched(pairs, *a):
        met = [(r.shard, *r.queries) for r in pairs.collect()]
        assert len(met) == len(set(met)) and sorted(q for m in met for q in m[1:]) == sorted([*ids[::2]] * len({m[0] for m in met}))
        sent.append(broadcast_bytes(pairs._jdf.queryExecution().executedPlan()))
        return search(pairs, *a)

    monkeypatch.setattr(neighbours, "_search", watched)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # more than the queries, less than the shards
    try:
        got, want = answers(neighbours.nearest(spark, frame, shard_rows=10, query_rows=64)), brute_nearest(ids, x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # 300 queries of 512 bytes times some 60 shards are 9 MB; a small hash table is 1 MB
    assert sent[0] < 3e6
    assert {q: [v for v, _ in a] for q, a in got.items()} == {q: [v for v, _ in a] for q, a in want.items()}


def test_leading_rows_keep_what_rounding_could_put_first():
    s = np.array([0.5, 0.5, 0.5, 0.5 - 1e-14, 0.5 - 4e-14, 0.9, 0.1])
    node = np.array([[4, 3, 2, 1, 0, 8, 9], [0] * 7, [0] * 7])
    who = np.array([0, 0, 0, 0, 0, 1, 1])
    assert sorted(neighbours._leading(who, node, s, 2)) == [1, 2, 3, 5, 6]
    assert sorted(neighbours._leading(who, node, s, 3)) == [0, 1, 2, 3, 5, 6]
    assert len(neighbours._leading(who[:0], node[:, :0], s[:0], 2)) == 0
