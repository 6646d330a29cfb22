"""Stratified split properties."""
import math

from edcohort.operators.split import modular_order, stratified_split


def _data(spark, sizes):
    rows, sid = [], 0
    for outcome, n in enumerate(sizes):
        for _ in range(n):
            rows.append((sid, outcome))
            sid += 1
    return spark.createDataFrame(rows, "stay_id long, outcome int")


def test_every_row_once_and_counts(spark):
    sizes = [1, 9, 10, 11, 1000]
    df = _data(spark, sizes)
    out = stratified_split(df, "outcome")
    rows = out.collect()
    assert len(rows) == sum(sizes) and len({r.stay_id for r in rows}) == sum(sizes)
    for outcome, n in enumerate(sizes):
        got = {s: sum(1 for r in rows if r.outcome == outcome and r.split == s) for s in ("train", "val", "test")}
        assert got["train"] == math.floor(n * 0.8 + 0.5)
        assert got["val"] == math.floor(n * 0.1 + 0.5)
        assert abs(got["test"] - n * 0.1) <= 1


def test_stable_under_repartition(spark):
    df = _data(spark, [500, 300])
    a = {r.stay_id: r.split for r in stratified_split(df, "outcome").collect()}
    b = {r.stay_id: r.split for r in stratified_split(df.repartition(7), "outcome").collect()}
    c = {r.stay_id: r.split for r in stratified_split(df.repartition(3, "stay_id"), "outcome",
                                                          order=None, seed=42).collect()}
    assert a == b == c


def test_bucketed_rank_equals_global_rank(spark):
    df = _data(spark, [700, 300])
    out = stratified_split(df, "outcome", order=modular_order()).collect()
    for outcome in (0, 1):
        members = sorted((r for r in out if r.outcome == outcome), key=lambda r: ((r.stay_id * 7919) % 10007, r.stay_id))
        n = len(members)
        n_tr, n_va = math.floor(n * 0.8 + 0.5), math.floor(n * 0.1 + 0.5)
        expect = ["train"] * n_tr + ["val"] * n_va + ["test"] * (n - n_tr - n_va)
        assert [r.split for r in members] == expect


def test_first_n_any_size_and_type(spark):
    from edcohort.operators.split import first_n
    data = [(chr(97 + i % 7) if i % 11 else None, i) for i in range(500)]
    df = spark.createDataFrame(data, "s string, i int").repartition(5)
    want = sorted(data, key=lambda r: ("" if r[0] is None else r[0], r[1]))
    for n in (0, 1, 60, 499, 15_000):
        assert [tuple(r) for r in first_n(df, n, ["s", "i"]).collect()] == want[:n]


def test_first_n_by_ranges(spark):
    """The distributed cut: nulls, ties, identical rows, extra columns named like its own."""
    import collections

    from edcohort.operators.split import first_n
    data = [(None if i % 10 == 3 else i // 7 % 900, "x" if i % 3 else f"s{i}", i % 5, {"m": i % 2}) for i in range(20_000)]
    data += [(400, "x", 1, {"m": 1})] * 10_000                      # a third of the rows alike
    df = spark.createDataFrame(data, "k int, row string, part int, h map<string,int>").repartition(7)

    def key(r):
        return (r[0] is not None, r[0] or 0, r[1], r[2])

    want = sorted(data, key=key)
    for n in (1, 1_500, 2_000, 12_345, 29_999, 30_000, 50_000):
        out = first_n(df, n, ["k", "row", "part"], one_task_rows=0)
        assert out.columns == df.columns
        got = collections.Counter(key(r) for r in out.collect())
        assert got == collections.Counter(key(r) for r in want[:n])
    for cols in (["row", "k"], ["part"]):                           # a text first; ties beyond the order
        assert first_n(df, 9_000, cols, one_task_rows=0).count() == 9_000
    assert first_n(df.limit(0), 5, ["k"], one_task_rows=0).collect() == []


def test_first_n_spreads_equal_rows(spark):
    from edcohort.operators.split import _below_cut, _range_stage
    df = spark.range(100_000).selectExpr("CAST(id % 4 AS INT) AS k", "'same' AS v")
    _, counts = _range_stage(df, ["k"], 16)
    assert len(counts) == 16 and max(counts.values()) < 20_000
    near = _below_cut(spark.range(100_000), 5_000, "id")
    assert 5_000 <= near.count() < 6_000


def test_split_rows_are_not_shuffled(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).select(F.col("id").alias("stay_id"), (F.col("id") % 2).alias("outcome"),
                                  F.repeat(F.lit("x"), 50).alias("cleaned_text"))
    plan = stratified_split(df, "outcome")._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery", 1)[0]
    assert "Exchange" not in main and "Join" not in main


def test_split_edges(spark):
    df = spark.createDataFrame([(i, None if i < 3 else i % 2) for i in range(23)], "stay_id long, outcome int")
    out = stratified_split(df, "outcome").collect()
    assert len(out) == 23
    for outcome in (None, 0, 1):
        n = sum(r.outcome == outcome for r in out)
        got = [sum(r.split == s for r in out if r.outcome == outcome) for s in ("train", "val", "test")]
        assert got == [math.floor(n * 0.8 + 0.5), math.floor(n * 0.1 + 0.5),
                       n - math.floor(n * 0.8 + 0.5) - math.floor(n * 0.1 + 0.5)]
    assert stratified_split(df.limit(0), "outcome").collect() == []


def test_exact_quantiles_equal_percentile(spark):
    from pyspark.sql import functions as F
    from edcohort.operators.quantiles import exact_quantiles
    rows = [(g, float(v)) for g in range(3) for v in ([1, 2, 2, 2, 9, 1000, -5, 3.5, 1e15] * (g + 1))]
    rows += [(3, 7.0), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, "v", ps, ["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in ps])).alias("q"))
            .where("q is not null").collect()}
    assert set(got) == set(want) == {0, 1, 2, 3}
    for g in want:
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got[g], want[g])), (g, got[g], want[g])
    glob = exact_quantiles(df, "v", [0.5]).collect()
    assert abs(glob[0].q[0] - df.select(F.median("v")).first()[0]) < 1e-9
    assert exact_quantiles(df.limit(0), "v", [0.5]).first().q is None
