"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model.

Two models are trained on all trusted rows (labels with quality 1 and toxic 0)
but a held-out fifth. The units of the first are the characters of a word
between a start and an end mark, so a word's probability does not depend on its
neighbours. The second crosses the borders of words: it predicts the first
character of a word, or that the word is its predecessor again, from the last
``TAIL`` characters of the predecessor. So clean words that are repeated or
shuffled cost more than clean text.

Counts: words and borders of the trusted texts are counted in one pass
(combined before the shuffle), their n-grams are summed, lower orders take the
number of distinct left extensions. Trust is looked up in masks of 64 ids, a
table that is broadcast up to ``MASKS`` rows, so that texts stay where they are
read; only beyond that are they joined by a shuffle. Probabilities follow order by order from joins of count tables that
are sharded by context: n-gram with the sums of its context, then with the
probability of its suffix.

Scoring: the table is cut into shards of ``SHARD_ENTRIES`` entries by the two
characters before the predicted one, so all n-grams a position can ask for lie
in one shard (orders 1 and 2 in every one). One shard after the other is
sent to the tasks and joined with the n-grams of all texts inside them, and the
partial sums of a document are added. So the driver holds one shard at a time
however large the model grows, and the n-grams of the corpus are never shuffled
(pairs of document and word would take more room than the texts). Tasks keep the sums of words
they have met in a bounded cache.

A document's score is a lower bound of its mean negative log-probability (mean
minus ``MARGIN`` standard errors), so that short texts need clear evidence; its
border score is the same over its borders with ``BORDER_MARGIN``. A document is
rejected when either is over its language's threshold: the ``QUANTILE`` (or
``BORDER_QUANTILE``) of the held-out trusted documents' scores in that language.
Where a language has fewer than ``LEAST`` of them, its median times the same
quantile of all held-out scores relative to their language's median (the excess)
stands in, squared as it is itself drawn from few rows; where it has fewer than ``FEW``, the largest threshold of the others.
The threshold of words is multiplied by their excess once more, as slack for
clean texts on other matters than the trusted ones; that of borders has none.

Defined cases: a text without words (null, empty, white space) has no
perplexity and is rejected; a text of one word has no border score and is judged
by the other; without any trusted row nothing is rejected but
these; null is a language of its own; repeated rows have equal results; a
doc_id with several texts has one row per text; labels with a null doc_id or
null quality are not trusted; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Recent
from .common import Workspace, let, words

ORDER = 5
SHARD_ENTRIES = 4_000_000
QUANTILE = 0.99
BORDER_QUANTILE = 0.998
MARGIN = 2.0
BORDER_MARGIN = 1.0
LEAST = 200
FEW = 3
FOLDS = 5
#: Rows (of 16 bytes) up to which the trusted ids are broadcast.
MASKS = 2_000_000
CACHE_WORDS = 250_000
#: Longer words are scored in parts of this many characters.
WORD_CHARS = 64
START, END = "\x02", "\x03"
#: The next word, where it is the one before it again.
AGAIN = "\x04"
#: Characters of a word (after its start mark) that predict the next word.
TAIL = 3
#: Parts the n-gram hashes of the two models.
BORDER_SALT = 100
U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)


def _trusted_ids(labels: DataFrame) -> DataFrame:
    return (labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
            .select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull()))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(_trusted_ids(labels).distinct(), "doc_id", "left_semi")


def trusted_texts(ws: Workspace, docs: DataFrame, labels: DataFrame, limit: int = MASKS) -> DataFrame:
    """The trusted rows of ``docs``. Ids are kept as (id div 64, mask of 64 bits):
    an eighth of a byte to 16 bytes an id. Up to ``limit`` such rows are
    broadcast, more are joined by a shuffle."""
    def place(doc_id: Column) -> Column:
        return doc_id.bitwiseAND(F.lit(63)).cast("int")

    block = F.shiftright(F.col("doc_id"), 6).alias("block")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("doc_id")))
    masks = ws.put(_trusted_ids(labels).groupBy(block).agg(F.bit_or(bit).alias("mask")), "masks")
    small = masks.count() <= limit
    rows = docs.withColumn("block", block).join(F.broadcast(masks) if small else masks, "block")
    return rows.filter(F.getbit("mask", place(F.col("doc_id"))) == 1).drop("block", "mask")


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(FOLDS))


def unit_counts(texts: DataFrame) -> DataFrame:
    """(s, c): the words of the texts and the borders between them, and their
    counts. A border is the end of a word, a space (which no word holds) and the
    first character of the next word, or ``AGAIN``."""
    def border(v: Column, n: Column) -> Column:
        return F.concat(F.substring(F.concat(F.lit(START), v), -TAIL, TAIL), F.lit(" "),
                        F.when(v == n, F.lit(AGAIN)).otherwise(F.substring(n, 1, 1)))

    units = let(words(F.col("text")), lambda a: F.concat(a, F.zip_with(
        F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.size(a)), border)))
    return texts.select(F.explode(units).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))


def ngram_counts(units: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): the longest n-grams that end at each position of the words, and
    their counts."""
    parts = units.filter(~F.contains(F.col("s"), F.lit(" "))).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("s") - 1) / F.lit(WORD_CHARS)).cast("int")),
        lambda i: F.concat(F.lit(START), F.substring(F.col("s"), i * WORD_CHARS + 1, F.lit(WORD_CHARS)), F.lit(END)))
    ).alias("s"), "c")
    grams = parts.select(F.explode(F.transform(
        F.sequence(F.lit(2), F.char_length("s")),
        lambda j: F.substring(F.col("s"), F.greatest(j - (order - 1), F.lit(1)),
                              F.least(j, F.lit(order))))).alias("g"), "c")
    return grams.groupBy("g").agg(F.sum("c").alias("c"))


def border_counts(units: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): the longest n-grams that end at the first character of a word
    with a word before it, and their counts."""
    borders = units.filter(F.contains(F.col("s"), F.lit(" ")))
    return borders.groupBy(F.substring("s", -order, order).alias("g")).agg(F.sum("c").alias("c"))


def _levels(ws: Workspace, grams: DataFrame, order: int) -> dict[int, DataFrame]:
    """length -> (g, c): counts for the longest n-grams and those at a word's
    start, numbers of distinct left extensions for the others."""
    top = ws.put(grams.withColumn("k", F.char_length("g")), "top")
    levels = {order: top.filter(F.col("k") == order).select("g", "c")}
    for k in range(order - 1, 0, -1):
        extended = levels[k + 1].select(F.substring("g", 2, k).alias("g")).groupBy("g").agg(
            F.count(F.lit(1)).alias("c"))
        at_start = top.filter((F.col("k") == k) & (k > 1)).select("g", "c")
        levels[k] = ws.put(extended.unionAll(at_start), f"counts-{k}")
    return levels


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams with count 1 to 4."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.1), top) for x, top in zip(d, (0.95, 1.9, 2.85), strict=True))


def model(ws: Workspace, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """Of the longest n-grams (g, c): rows (g, k, p, back): probability of each seen n-gram, and (as rows with
    null p) the back-off weight of each context."""
    levels = _levels(ws, grams, order)
    below, out = None, None
    for k in range(1, order + 1):
        level = levels[k]
        c = F.col("c")
        tally = level.agg(*[F.count_if(c == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts([tally[f"n{i}"] for i in (1, 2, 3, 4)])
        counts = level.withColumn("ctx", F.substring("g", 1, k - 1))
        sums = counts.groupBy("ctx").agg(
            F.sum("c").alias("total"),
            ((F.count_if(c == 1) * d1 + F.count_if(c == 2) * d2 + F.count_if(c > 2) * d3) / F.sum("c")).alias("back"))
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        if k == 1:
            size = level.count() + 1  # and one for all unseen characters
            lower = counts.withColumn("lower", F.lit(1.0 / size))
        else:
            lower = counts.withColumn("tail", F.substring("g", 2, k - 1)).join(
                below.select(F.col("g").alias("tail"), F.col("p").alias("lower")), "tail")
        seen = lower.join(sums, "ctx").select(
            "g", F.lit(k).alias("k"), ((c - cut) / F.col("total") + F.col("back") * F.col("lower")).alias("p"))
        below = ws.put(seen, f"level-{k}")
        backs = sums.select(F.col("ctx").alias("g"), F.lit(k - 1).alias("k"), F.lit(None).cast("double").alias("p"),
                            (F.col("back") / (F.lit(size) if k == 1 else F.lit(1.0))).alias("back"))
        rows = below.withColumn("back", F.lit(None).cast("double")).unionAll(backs)
        out = rows if out is None else out.unionAll(rows)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def _grams(codes: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the k characters that end before place ``at``."""
    h = np.full(len(at), k + salt, U64)
    for i in range(k, 0, -1):
        h = h * MULTIPLIER + codes[at - i] + U64(1)
    return _mix(h)


def _keyed(table: DataFrame, shards: int) -> DataFrame:
    """key, value (log p or log back-off), kind, shard (-1: all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("g").to_pylist()
            n = np.array([len(g) for g in grams], np.int64)
            codes = _codes("".join(grams))
            ends = np.cumsum(n)
            key, shard = np.zeros(len(n), U64), np.full(len(n), -1, np.int64)
            p = batch.column("p").to_numpy(zero_copy_only=False)
            weight = np.isnan(p)
            border = batch.column("border").to_numpy(zero_copy_only=False)
            for k in np.unique(n):
                for salt in (0, BORDER_SALT):
                    some = (n == k) & (border == (salt > 0))
                    key[some] = _grams(codes, ends[some], int(k), salt)
            before = ends - ~weight  # the predicted character of an n-gram does not choose the shard
            held = n - ~weight >= 2
            shard[held] = (_grams(codes, before[held], 2) % U64(shards)).astype(np.int64)
            value = np.log(np.where(weight, batch.column("back").to_numpy(zero_copy_only=False), p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(value.astype(np.float32)), pa.array(weight),
                 pa.array(shard.astype(np.int32))], ["key", "value", "weight", "shard"])

    return table.select("g", "p", "back", "border").mapInArrow(run, "key long, value float, weight boolean, shard int")


class Shard:
    """Scores words by the positions whose n-grams lie in this shard."""

    def __init__(self, key: np.ndarray, value: np.ndarray, weight: np.ndarray, shard: int, shards: int, order: int):
        key = key.view(U64)
        self.tables = []
        for kind in (False, True):
            at = np.flatnonzero(weight == kind)
            at = at[np.argsort(key[at], kind="stable")]
            self.tables.append((key[at], value[at]))
        self.shard, self.shards, self.order = shard, shards, order
        self.key = xxhash.xxh3_128_hexdigest(b"".join(
            [bytes(f"{shard}/{shards}/{order}", "ascii"), *(a.tobytes() for t in self.tables for a in t)]))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]

    def costs(self, ws: list[str]) -> list[bytes]:
        """Per word (sum, sum of squares, number) of negative log-probabilities."""
        parts = [START + w[a:a + WORD_CHARS] + END for w in ws for a in range(0, len(w), WORD_CHARS)]
        owner = np.repeat(np.arange(len(ws)), [-(-len(w) // WORD_CHARS) for w in ws])
        return self._costs(ws, parts, owner, False)

    def border_costs(self, borders: list[str]) -> list[bytes]:
        """The same per border (of which the last character is predicted)."""
        return self._costs(borders, borders, np.arange(len(borders)), True)

    def _costs(self, ws: list[str], parts: list[str], owner: np.ndarray, border: bool) -> list[bytes]:
        salt = BORDER_SALT if border else 0
        n = np.array([len(p) for p in parts], np.int64)
        codes = _codes("".join(parts))
        start = np.repeat(np.cumsum(n) - n, n)
        place = np.arange(len(codes)) - start
        at = np.cumsum(n) - 1 if border else np.flatnonzero(place > 0)
        word = np.repeat(owner, n)[at]
        if self.shards > 1:
            two = place[at] > 1
            mine = np.full(len(at), self.shard == 0)  # a word's first position has one character before it
            mine[two] = _grams(codes, at[two], 2) % U64(self.shards) == U64(self.shard)
            at, word = at[mine], word[mine]
        length = np.minimum(place[at] + 1, self.order)
        cost = np.zeros(len(at), np.float64)
        open_ = np.arange(len(at))
        for k in range(self.order, 0, -1):
            now = open_[length[open_] >= k]
            if not len(now):
                continue
            seen, value = self._find(self.tables[0], _grams(codes, at[now] + 1, k, salt))
            cost[now[seen]] -= value[seen]
            missed = now[~seen]
            known, back = self._find(self.tables[1], _grams(codes, at[missed], k - 1, salt))
            cost[missed[known]] -= back[known]
            done = np.zeros(len(at), bool)
            done[now[seen]] = True
            open_ = open_[~done[open_]]
        out = np.zeros((len(ws), 3))
        out[:, 0] = np.bincount(word, cost, len(ws))
        out[:, 1] = np.bincount(word, cost * cost, len(ws))
        out[:, 2] = np.bincount(word, minlength=len(ws))
        return [row.tobytes() for row in out]


_CACHES: dict[str, tuple[Recent, Recent]] = {}


def _caches(shard: Shard) -> tuple[Recent, Recent]:
    """Costs of words and of borders. One pair per Python worker and shard, so
    later tasks find it filled."""
    if shard.key not in _CACHES:
        _CACHES.clear()
        _CACHES[shard.key] = (Recent(lambda w: shard.costs([w])[0], CACHE_WORDS),
                              Recent(lambda b: shard.border_costs([b])[0], CACHE_WORDS))
    return _CACHES[shard.key]


def _looked_up(cache: Recent, make: Callable[[list[str]], list[bytes]], keys: list[str]) -> np.ndarray:
    """[keys, 3] costs; those not in the cache are made many at a time."""
    out = []
    for a in range(0, len(keys), CACHE_WORDS // 2):
        part = keys[a:a + CACHE_WORDS // 2]
        new = [k for k in part if k not in cache and k not in cache.old]
        for k, c in zip(new, make(new) if new else [], strict=True):
            cache.add(k, c)
        out.extend(map(cache.__getitem__, part))
    return np.frombuffer(b"".join(out)).reshape(-1, 3)


def _sums(texts: list[list[bytes]], shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Per text the summed costs [texts, 3] of its words and of its borders."""
    words_, borders = _caches(shard)
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    known = [w.decode("utf-8", "replace") for w in ids]
    cost = _looked_up(words_, shard.costs, known)[at]

    tails: dict[str, int] = {}
    heads: dict[str, int] = {AGAIN: 0}
    tail = np.array([tails.setdefault((START + w)[-TAIL:] + " ", len(tails)) for w in known], np.int64)
    head = np.array([heads.setdefault(w[0], len(heads)) for w in known], np.int64)
    inside = owner[1:] == owner[:-1]
    before, after = at[:-1][inside], at[1:][inside]
    pair = tail[before] * len(heads) + np.where(before == after, 0, head[after])
    distinct, place = np.unique(pair, return_inverse=True)
    tail_text, head_text = list(tails), list(heads)
    keys = [tail_text[p // len(heads)] + head_text[p % len(heads)] for p in distinct.tolist()]
    border_cost = _looked_up(borders, shard.border_costs, keys)[place]
    return tuple(np.stack([np.bincount(o, c[:, i], len(texts)) for i in range(3)], 1)
                 for o, c in ((owner, cost), (owner[1:][inside], border_cost)))


SUMS = ("cost", "squares", "n", "border_cost", "border_squares", "borders")


def _partial(docs: DataFrame, shard: Shard) -> DataFrame:
    """doc_id, text_hash, lang and SUMS: one shard's share per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
                sums = np.concatenate(_sums(texts, shard), 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), part.column("lang"),
                     *(pa.array(sums[:, i]) for i in range(len(SUMS)))],
                    ["doc_id", "text_hash", "lang", *SUMS])

    return docs.select("doc_id", "text_hash", "lang", "text").mapInArrow(
        run, "doc_id long, text_hash long, lang string, " + ", ".join(f"{c} double" for c in SUMS))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.col("lang").cast("string").alias("lang"), text.alias("text"))


def perplexities(spark: SparkSession, docs: DataFrame, labels: DataFrame, order: int = ORDER,
                 shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, text_hash, lang, n_chars, perplexity, score, border; one row per
    text."""
    ws = Workspace(spark, "perplexity")
    rows = _rows(docs)
    texts = trusted_texts(ws, rows, labels).filter(_fold(F.col("doc_id")) > 0)
    units = ws.put(unit_counts(texts), "units")
    inside = ws.put(model(ws, ngram_counts(units, order), order), "inside")
    steps = [f"{kind}-{k}" for k in range(1, order + 1) for kind in ("counts", "level")]
    ws.drop("top", *steps)
    across = model(ws, border_counts(units, order), order)
    table = ws.put(inside.withColumn("border", F.lit(False)).unionAll(across.withColumn("border", F.lit(True))), "model")
    shards = max(1, -(-table.count() // shard_entries))
    keyed = ws.put(_keyed(table, shards), "keyed")
    ws.drop("top", "inside", "model", "units", "masks", *steps)
    parts = None
    for i in range(shards):
        # at most about shard_entries rows of 13 bytes, freed before the next shard
        own = keyed.filter(F.col("shard").isin(i, -1)).toArrow()
        part = _partial(rows, Shard(*(own.column(c).to_numpy() for c in ("key", "value", "weight")), i, shards, order))
        if shards > 1:
            part = ws.put(part, f"partial-{i}")
        parts = part if parts is None else parts.unionAll(part)
    sums = parts.groupBy("doc_id", "text_hash", "lang").agg(
        *(F.sum(c).alias(c) for c in SUMS), (F.count(F.lit(1)) / shards).alias("copies"))
    n = F.col("n") / F.col("copies")

    def bound(cost: str, squares: str, n: Column, margin: float) -> Column:
        mean = F.try_divide(cost, n)
        spread = F.sqrt(F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0)))
        return mean - margin * F.try_divide(spread, F.sqrt(n))

    scored = sums.select("doc_id", "text_hash", "lang", n.cast("long").alias("n_chars"), F.exp(F.try_divide("cost", "n")).alias("perplexity"),
                         bound("cost", "squares", F.col("n"), MARGIN).alias("score"),
                         bound("border_cost", "border_squares", F.col("borders"), BORDER_MARGIN).alias("border"))
    return ws.put(scored, "scored")


def _limits(held: DataFrame, scored: DataFrame, ws: Workspace, score: str, limit: str, quantile: float,
            slack: bool) -> DataFrame:
    """``scored`` with the language's threshold of ``score``."""
    by_lang = held.filter(F.col(score).isNotNull()).groupBy("lang").agg(
        F.percentile_approx(score, quantile, 10_000).alias("high"),
        F.percentile_approx(score, 0.5, 10_000).alias("median"), F.count(F.lit(1)).alias("n"))
    by_lang = ws.put(by_lang.filter(F.col("n") >= FEW).withColumnRenamed("lang", "of_lang"), f"languages-{score}")
    near = F.col("lang").eqNullSafe(F.col("of_lang"))
    excess = held.join(by_lang, near).agg(
        F.percentile_approx(F.col(score) / F.col("median"), quantile, 10_000)).first()[0]
    own = F.when(F.col("n") >= LEAST, F.col("high")).otherwise(F.col("median") * F.lit(excess).cast("double") ** 2)
    limits = by_lang.select("of_lang", (own * F.lit(excess).cast("double") if slack else own).alias("own"))
    widest = limits.agg(F.max("own")).first()[0]
    return (scored.join(limits, near, "left")
            .withColumn(limit, F.coalesce("own", F.lit(widest).cast("double"), F.lit(float("inf"))))
            .drop("of_lang", "own"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``perplexities`` with the two thresholds and kept."""
    ws = Workspace(spark, "thresholds")
    scored = perplexities(spark, docs, labels)
    held = trusted_rows(scored, labels).filter((_fold(F.col("doc_id")) == 0) & F.col("score").isNotNull())
    limited = _limits(held, scored, ws, "score", "threshold", QUANTILE, True)
    limited = _limits(held, limited, ws, "border", "border_threshold", BORDER_QUANTILE, False)
    return limited.withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False))
                              & F.coalesce(F.col("border") <= F.col("border_threshold"), F.lit(True)))


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op3: doc_id, lang, n_chars, perplexity, score, border, threshold,
    border_threshold, kept."""
    return judge(spark, docs, labels).drop("text_hash")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns. A row whose
    doc_id is null cannot be judged by labels or id and is judged by its text."""
    rejected = judge(spark, docs, labels).filter(~F.col("kept")).select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = (F.col("doc.doc_id").cast("long").eqNullSafe(F.col("bad_id"))
            & F.xxhash64(F.col("doc.text").cast("string")).eqNullSafe(F.col("bad_hash")))
    return docs.select(F.struct("*").alias("doc")).join(
        rejected.hint("shuffle_hash"), same, "left_anti").select("doc.*")
