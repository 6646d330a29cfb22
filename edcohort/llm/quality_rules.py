"""Quality rules with host-level verdicts, native DataFrame functions only.

Per text (null: no words): word and line counts as the base rules ask, then
three further rules on the same counts: many symbols, many repeated lines, odd
mean word length. Rule failures are summed by host (``source``), host rates
are shrunk by an empirical beta prior fitted to all hosts by moments, and the
host verdict is joined back: a document that passes the base rules goes when
it fails at least two further rules, or one on a host whose shrunk failure
rate is over ``BAD_RATE``. A clean document on a bad host stays.

Plan: one map pass over the texts makes a narrow table, staged in the shared
folder; hosts are summed with map-side partial aggregates (a host with a third
of all rows is one row per task); the prior is two numbers; the verdicts of
hosts join back on the narrow rows, where a hot host is split by the skew join.

Defined cases: null or empty text has no words and fails the base rules; a
null source is a host of its own; an empty table gives an empty result;
repeated rows are judged each by itself; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, Workspace, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
WORD_CHARS = (2, 15)
BAD_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (2.0, 1000.0)


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: windows
    sorted by hash, neighbours with equal hash, their positions in order,
    lengths of their union."""
    def repeated(s: Column) -> Column:
        n = F.size(s)
        hit = F.filter(s, lambda e, k: (
            ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"]))))
        return F.array_sort(F.transform(hit, lambda e: e["i"]))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        let(pairs, repeated), zero,
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p.cast("long"), a["end"])).alias("n"),
                              (p + F.lit(WINDOW).cast("long")).alias("end")),
        lambda a: a["n"])


def _repeat_words(word_array: Column) -> Column:
    def over(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                             lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))

    return let(word_array, lambda w: F.when(F.size(w) > WINDOW, over(w)).otherwise(F.lit(0).cast("long")))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the base counts of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word_lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
        words(text).alias("w"), word_lines.alias("lines"),
        F.char_length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return base.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_word_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _soft_failures() -> Column:
    n, lo_hi = F.col("n_words"), WORD_CHARS
    rules = [100 * F.col("n_symbols") > SYMBOL_PERCENT * n,
             100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_word_lines"),
             (F.col("word_chars") < lo_hi[0] * n) | (F.col("word_chars") > lo_hi[1] * n)]
    return sum((r.cast("int") for r in rules), F.lit(0))


def host_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments over the hosts' failure rates: two numbers."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v")).first()
    m = 0.5 if row["m"] is None else min(max(row["m"], 1e-6), 1 - 1e-6)
    weight = m * (1 - m) / row["v"] - 1 if row["v"] > 0 else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return m * weight, (1 - m) * weight


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, host_rate, kept."""
    ws = Workspace(spark, "rules")
    rows = ws.put(text_counts(docs).withColumn("base_failed", _base_failed())
                  .withColumn("soft", _soft_failures()), "counts")
    failed = F.col("base_failed") | (F.col("soft") > 0)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"))
    hosts = ws.put(hosts, "hosts")
    alpha, beta = host_prior(hosts)
    verdicts = hosts.select(
        F.col("host").alias("of_host"),
        ((F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"))
    allowed = F.when(F.col("host_rate") > BAD_RATE, 0).otherwise(1)
    return (rows.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
            .withColumn("kept", ~F.col("base_failed") & (F.col("soft") <= allowed))
            .drop("of_host"))


def rules_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op5: doc_id, counts, base_failed, kept, then host and host_rate."""
    return judge(spark, docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("host"), F.round("host_rate", 9).cast(T.DoubleType()).alias("host_rate"))


SQL = r"""
WITH t AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, host, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(0, 5)) AS d) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls) AS n_word_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         (100 * n_symbols > 10 * n_words)::INT + (100 * n_dup_lines > 30 * n_word_lines)::INT
         + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS soft
  FROM counts),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft > 0) AS failed FROM judged GROUP BY host),
m AS (
  SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_pop(failed / n), 0) AS v FROM hosts),
p AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END, 2), 1000) AS weight FROM m),
rates AS (
  SELECT host, (failed + m * weight) / (n + weight) AS host_rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND soft <= (CASE WHEN host_rate > 0.5 THEN 0 ELSE 1 END) AS kept,
       judged.host AS host, round(host_rate, 9) AS host_rate
FROM judged JOIN rates ON judged.host IS NOT DISTINCT FROM rates.host
"""
