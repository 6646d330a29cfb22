"""Reproducible stratified split (W5), its checks (A21) and exact first rows (T4).

Every row has a place: bucket ``b``, order key ``k``, id, where ``b`` is
monotone in ``k``. Counts per (stratum, bucket) form a small table whose running
sums show which bucket holds each cut; only the ids of these buckets are ranked,
and the place of the row at each cut is all that is carried on: two places per
stratum. A row's split then follows from comparing its own place with them, so
the rows themselves (with their texts) are neither joined nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import write_stage

DEFAULT_BUCKETS = 4096
#: Rows that a top-k may bring into one task; also the aim for a range partition.
ONE_TASK_ROWS = 1_000_000
#: Accuracy of the sketch that finds a cut (its ranks are off by rows / SKETCH at most).
SKETCH = 10_000


def hash_order(id_col: str = "stay_id", seed: int = 42, buckets_log2: int = 12) -> tuple[Column, Column]:
    """Seeded pseudo-random order: 64-bit hash, bucket = its top bits."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    b = F.shiftright(h, 64 - buckets_log2) + F.lit(1 << (buckets_log2 - 1))
    return h, b


def modular_order(id_col: str = "stay_id", mult: int = 7919, modulus: int = 10007,
                  buckets: int = DEFAULT_BUCKETS) -> tuple[Column, Column]:
    """Arithmetic order ``(id * mult) % modulus`` (reproducible in any SQL
    engine), bucket = its scaled value."""
    k = F.pmod(F.col(id_col) * mult, F.lit(modulus))
    return k, F.floor(k * buckets / modulus)


def _round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def stratified_split(df: DataFrame, outcome_col: str = "outcome", train_ratio: float = 0.8,
                     val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42,
                     id_col: str = "stay_id", order: tuple[Column, Column] | None = None) -> DataFrame:
    """Add ``split`` ∈ {train, val, test}. Per stratum of size n:
    n_train = round(n·train), n_val = round(n·val), the rest is test
    (rounding half up). Every row lands in exactly one split, and the result
    does not depend on the partitioning. The input's ids, keys and outcomes
    are read for the counts and again for the cut buckets, so pass a stage
    table when it comes from an expensive plan."""
    k, b = order if order is not None else hash_order(id_col, seed)
    stratum = F.coalesce(F.col(outcome_col).cast("string"), F.lit("\0"))
    place = F.struct(b.alias("b"), k.alias("k"), F.col(id_col).alias("id"))
    keyed = df.select(stratum.alias("s"), place.alias("p")).select("s", "p.b", "p")
    counts = keyed.groupBy("s", "b").agg(F.count(F.lit(1)).alias("cnt"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("cnt").over(Window.partitionBy("s"))
    total = train_ratio + val_ratio + test_ratio
    n_train, n_val = _round_half_up(n * (train_ratio / total)), _round_half_up(n * (val_ratio / total))
    cuts = counts.select("s", "b", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("off"), F.array(
        F.struct(F.lit("train").alias("name"), n_train.alias("at")),
        F.struct(F.lit("val").alias("name"), (n_train + n_val).alias("at"))).alias("cut"))
    hit = (cuts.select("s", "b", "cnt", "off", F.inline("cut"))
           .where((F.col("off") < F.col("at")) & (F.col("at") <= F.col("off") + F.col("cnt"))))
    inside = keyed.join(hit.select("s", "b").distinct(), ["s", "b"], "left_semi")
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("p")))
    last = (ranked.join(hit, ["s", "b"]).where(F.col("off") + F.col("r") == F.col("at"))
            .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "s", "name"), "p")))).scalar())

    def upto(name: str) -> Column:
        return place <= F.try_element_at(last, F.concat_ws("|", stratum, F.lit(name)))

    return df.withColumn("split", F.when(upto("train"), "train").when(upto("val"), "val").otherwise("test"))


def split_validation(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Per split: size, outcome rate, text share, nulls in outcome and
    has_text, rows with has_text but no text."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col(outcome).cast("double")) * 100.0).alias("outcome_pct"),
        (F.avg(F.col("has_text").cast("double")) * 100.0).alias("text_pct"),
        F.count_if(F.col(outcome).isNull()).alias("null_outcome"),
        F.count_if(F.col("has_text").isNull()).alias("null_has_text"),
        F.count_if(F.col("has_text") & F.col("cleaned_text").isNull()).alias("has_text_without_text"))


def _below_cut(df: DataFrame, n: int, column: str) -> DataFrame:
    """Rows that can be among the first ``n`` by ``column``: those up to a value
    whose rank a sketch puts safely beyond ``n`` (a filter that reaches the
    scan). Columns a sketch does not take leave ``df`` as it is."""
    if not isinstance(df.schema[column].dataType, (T.NumericType, T.DateType)):
        return df
    c = F.col(column)
    rows, valued = df.agg(F.count(F.lit(1)), F.count(c)).first()
    if n <= rows - valued:
        return df.where(c.isNull())
    share = (n - (rows - valued)) / max(valued, 1) + 2.0 / SKETCH
    if share >= 1.0:
        return df
    last = df.agg(F.percentile_approx(c, F.lit(share), F.lit(SKETCH))).first()[0]
    return df.where(c.isNull() | (c <= F.lit(last)))


def _range_stage(df: DataFrame, order_cols: list[str], partitions: int) -> tuple[DataFrame, dict[int, int]]:
    """``df`` as a written table (row, keys ``k``, range partition ``part``) and
    the rows per partition. Ties are told apart by the row's hash and place, so
    that no value of the order columns is bound to one task."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)],
                    F.xxhash64(*hashed).alias("h"), F.monotonically_increasing_id().alias("i"))
    rows = df.select(F.struct("*").alias("row"), keys.alias("k"))
    spread = rows.repartitionByRange(partitions, "k").withColumn("part", F.spark_partition_id())
    stage = write_stage(spread, "first_n")
    return stage, {r["part"]: r["count"] for r in stage.groupBy("part").count().collect()}


def first_n(df: DataFrame, n: int, order_cols: list[str], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (ascending, nulls first),
    exactly, for any n and any column types; which of several rows equal in all
    of ``order_cols`` are taken is not defined.

    Up to ``one_task_rows`` this is Spark's top-k, and rows come in order.
    Beyond it, the rows up to the cut (found by a sketch of the first column)
    are written partitioned by range, the partitions' counts (a few numbers each
    on the driver) show which of them holds the n-th row, and only that one is
    cut by a sort: whole partitions pass as they are, in no particular order,
    and no task sees more rows than a partition. Jobs run at the call."""
    if n <= one_task_rows:
        return df.orderBy(*order_cols).limit(n)
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n // ONE_TASK_ROWS)
    near = _below_cut(df, n, order_cols[0])
    stage, counts = _range_stage(near, order_cols, partitions)
    if near is not df and sum(counts.values()) < n:
        stage, counts = _range_stage(df, order_cols, partitions)
    border, before = -1, 0
    for part in sorted(counts):
        border = part
        if before + counts[part] >= n:
            break
        before += counts[part]
    whole = stage.where(F.col("part") < border)
    rest = stage.where(F.col("part") == border).orderBy("k").limit(n - before)
    return whole.unionAll(rest).select("row.*")
