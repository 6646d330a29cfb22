"""Line de-duplication across documents.

Every text is split at LF. A line's key is the line without ASCII white space
at both ends, A-Z in lower case. Keys of at least ``min_chars`` code points
that occur in at least ``min_docs`` documents lose all their lines, except in
the largest ``doc_id`` that holds the key. All other lines stay and are joined
again in their order.

Plan: explode lines -> 128-bit hash of the key -> distinct (hash, document) ->
documents per hash (partial aggregates combine before the shuffle, so a line
held by a third of all rows is one row per task) -> hashes over the threshold
join the distinct pairs -> one row per document with the hashes it loses ->
shuffled hash join with the documents, whose lines are filtered in place, in
their order.

Defined cases: a null or empty text is one empty line; an empty table gives an
empty result; rows with a repeated doc_id count as one document, and each row
is cleaned by itself; rows with a null doc_id count for no key and lose
nothing; ties cannot occur (the largest id keeps its lines, all of them);
further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, id_text

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _hash(stripped: Column) -> Column:
    """128 bits: at 10^12 distinct lines 64 would collide."""
    return F.unhex(F.md5(ascii_lower(stripped)))


def dropped_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, hashes): the key hashes whose lines a document loses."""
    held = (id_text(docs).filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
            .select("doc_id", F.explode(_lines(F.col("text"))).alias("line"))
            .select("doc_id", _strip(F.col("line")).alias("line"))
            .filter(F.char_length("line") >= min_chars)
            .select("doc_id", _hash(F.col("line")).alias("h"))
            .distinct())
    common = (held.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
              .filter(F.col("n_docs") >= min_docs).select("h", "keeper"))
    return (held.join(common, "h").filter(F.col("doc_id") != F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_list("h").alias("hashes")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the text de-duplicated, as one struct
    ``doc``, plus ``n_lines`` and ``n_dropped`` (long)."""
    drops = dropped_hashes(docs, min_chars, min_docs).withColumnRenamed("doc_id", "drop_id")
    rows = docs.select(F.struct("*").alias("doc"))
    joined = rows.join(drops.hint("shuffle_hash"),
                       F.col("doc.doc_id").cast("long") == F.col("drop_id"), "left")

    def stays(line: Column) -> Column:
        s = _strip(line)
        return (F.char_length(s) < min_chars) | ~F.array_contains(F.col("hashes"), _hash(s))

    text = F.col("doc.text").cast("string")
    split = joined.select(
        "doc", F.size(_lines(text)).cast("long").alias("n_lines"),
        F.when(F.col("hashes").isNotNull(), F.filter(_lines(text), stays)).alias("left"))
    return split.select(
        F.col("doc").withField("text", F.when(F.col("left").isNotNull(), F.array_join("left", "\n"))
                               .otherwise(F.coalesce(text, F.lit("")))).alias("doc"),
        "n_lines",
        F.coalesce(F.col("n_lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """op10: doc_id, n_lines, n_dropped, kept_sha256 per document."""
    return dedup_lines(id_text(docs)).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("doc.text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.doc_id, pos, line, c.k IS NOT NULL AND keyed.doc_id <> c.keeper AS drop_it
  FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE drop_it)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
