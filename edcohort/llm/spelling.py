"""Spelling variant grouping on a relational trie.

Words are runs of letters (with the contract's planted slips), of at least
``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences. Two words are near if
they differ by exactly one inserted, deleted or replaced code point. A word's
form is its near word of largest count, if that has at least ``RATIO`` times the
word's own; its root is where following forms ends.

The trie is a table of edges, (length, node, next letter) -> (label, next node),
where a node is a prefix and the label is what all words below the edge have in
common. There is one trie per word length, so a replacement stays in the word's
own trie and an insertion moves to the next one; deletions are insertions seen
from the other side. A state is (word, target length, node, rest of the word)
with its one edit spent:

* the first join takes every word at every node of its own path and spends the
  edit on each other edge there (for a replacement only on larger letters, the
  pair is found once);
* every further join follows the edge of the next letter and compares its label
  at once, so rounds are as many as branchings, not letters;
* a state whose edge leads to one word only ends there: its rest equals the
  word's rest, or it dies.

A word has its whole first half before the edit or its whole last half after
it, so the edit is looked for in the second half of the words and of the
reversed words: no state ever branches near the root, where nodes are hot.

Plan: one pass over the texts with map-side counts; anchors (length, hash of
the first half) that no second word shares are dropped by a semi join before
words are spread over their nodes, so a very long word costs L^2 / 2 bytes only
if another shares half of it; each round is a written table. A node has at most
as many edges as letters exist (84), so a hot node only multiplies its words by
that; the skew join splits it. Pairs are counted per word by an aggregate; roots
by pointer jumping (forms grow tenfold each step, so few rounds).

Defined cases: null and empty texts have no words; a null doc_id plants no
slip; repeated rows count each; an empty table gives an empty result; equal
counts go to the smaller word in code-point order; further columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, id_text

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
#: A run whose checksum this divides loses one letter.
SLIP = 31
#: Prefixes longer than this are named by their hash.
NAME_CHARS = 40
#: Edges of words up to this length are small enough for a hash join.
HASH_CHARS = 64


def runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, run: the letter runs of at least ``min_chars``, A-Z in lower case."""
    found = id_text(docs).select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    # lower() agrees with the rule unless the run holds an accented capital
    wide = F.octet_length("run") > F.char_length("run")
    return found.select("doc_id", F.when(wide & F.rlike("run", F.lit("[À-Þ]")), ascii_lower(F.col("run")))
                        .otherwise(F.lower("run")).alias("run"))


def with_slips(found: DataFrame) -> DataFrame:
    """word: the runs, one letter deleted where the checksum asks for it."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    return found.withColumn("h", F.coalesce(h, F.lit(1))).select(
        F.when(F.col("h") % SLIP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.lit(1 << 30))))
        .otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n."""
    return (with_slips(runs(docs, min_chars)).filter(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def _node(word: Column, depth: Column) -> Column:
    prefix = F.substring(word, F.lit(1), depth)
    return F.when(depth <= NAME_CHARS, prefix).otherwise(F.concat(F.lit("#"), F.md5(prefix.cast("binary"))))


def _from(word: Column, at: Column) -> Column:
    """The rest of ``word`` from code point ``at`` (from 0) on."""
    return F.substring(word, at + 1, F.lit(1 << 30))


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def anchored(words: DataFrame) -> DataFrame:
    """(word, size) of words that share their first half with another of their
    length, or one shorter or longer."""
    rows = words.select("word", F.char_length("word").alias("size"))

    def anchor(size: Column) -> Column:
        return F.xxhash64(size, F.substring("word", F.lit(1), _half(size - 1)))

    both = rows.select("word", "size", F.explode(F.array(
        anchor(F.col("size")), anchor(F.col("size") + 1))).alias("anchor"))
    shared = both.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    return both.join(shared, "anchor", "left_semi").select("word", "size").distinct()


def _common(a: Column, b: Column) -> Column:
    """Code points that ``a`` and ``b`` (of one length) have in common before
    they part: the first difference by halving."""
    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"),
                        F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.char_length(a).alias("hi"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.char_length(a) + 1)).cast("int"))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def edges(rows: DataFrame) -> DataFrame:
    """size, node, letter -> label (the letters all words below the edge have in
    common after ``letter``), next (the node reached), hit (the word reached,
    null if there are several)."""
    size = F.col("size")
    spread = rows.select("word", "size", F.explode(F.sequence(_half(size - 1), size - 1)).alias("depth"))
    below = (spread.select("size", _node(F.col("word"), F.col("depth")).alias("node"), "depth",
                           F.substring("word", F.col("depth") + 1, F.lit(1)).alias("letter"), "word")
             .groupBy("size", "node", "letter")
             .agg(F.min("word").alias("lo"), F.max("word").alias("hi"), F.min("depth").alias("depth")))
    single = F.col("lo") == F.col("hi")
    below = below.withColumn("to", F.when(single, size).otherwise(_common(F.col("lo"), F.col("hi"))))
    return below.select(
        "size", "node", "letter",
        F.substring("lo", F.col("depth") + 2, F.col("to") - F.col("depth") - 1).alias("label"),
        F.when(~single, _node(F.col("lo"), F.col("to"))).alias("next"), F.when(single, F.col("lo")).alias("hit"))


def _followed(met: DataFrame) -> DataFrame:
    """States that took an edge: word, size, node, rest, hit, if the edge's label
    agrees with the rest of the word."""
    return met.filter(F.startswith("rest", F.col("label"))).select(
        "word", "size", F.col("next").alias("node"), _from(F.col("rest"), F.char_length("label")).alias("rest"), "hit")


def _at_edges(states: DataFrame, trie: DataFrame, keys: list[str]) -> DataFrame:
    """States with the edges at their node. A hash join holds its edges in memory
    and cannot spill; those of long words, that hold the word each, are sorted."""
    short = F.col("size") <= HASH_CHARS
    return (states.filter(short).join(trie.filter(short).hint("shuffle_hash"), keys)
            .unionByName(states.filter(~short).join(trie.filter(~short).hint("merge"), keys)))


def _first_states(rows: DataFrame, trie: DataFrame) -> DataFrame:
    """Every word at the nodes of its path, the edit spent on another edge."""
    size = F.col("size")
    kinds = F.array(F.struct(size.alias("target"), F.lit(1).alias("skip"), (size - 1).alias("last")),
                    F.struct((size + 1).alias("target"), F.lit(0).alias("skip"), size.alias("last")))
    start = (rows.select("word", "size", F.explode(kinds).alias("kind"))
             .select("word", F.col("kind.target").alias("size"), F.col("kind.skip").alias("skip"),
                     F.explode(F.sequence(_half(size), F.col("kind.last"))).alias("at")))
    start = start.select("word", "size", "skip", "at", _node(F.col("word"), F.col("at")).alias("node"))
    own = F.substring("word", F.col("at") + 1, F.lit(1))
    met = _at_edges(start, trie, ["size", "node"]).filter(
        F.when(F.col("skip") == 1, F.col("letter") > own).otherwise(F.col("letter") != own))
    return _followed(met.withColumn("rest", _from(F.col("word"), F.col("at") + F.col("skip"))))


def _near_one_way(ws: Workspace, words: DataFrame, name: str) -> DataFrame:
    """(a, b) near pairs, each once, whose edit lies in the second half."""
    rows = ws.put(anchored(words), f"{name}-rows")
    trie = ws.put(edges(rows), f"{name}-edges")
    states, hits, step = ws.put(_first_states(rows, trie), f"{name}-0"), [], 0
    while True:
        hits.append(states.filter("hit IS NOT NULL").select(F.col("word").alias("a"), F.col("hit").alias("b")))
        live = states.filter("hit IS NULL").select(
            "word", "size", "node", F.substring("rest", F.lit(1), F.lit(1)).alias("letter"),
            _from(F.col("rest"), F.lit(1)).alias("rest"))
        if live.isEmpty():
            return reduce(DataFrame.unionAll, hits)
        step += 1
        states = ws.put(_followed(_at_edges(live, trie, ["size", "node", "letter"])), f"{name}-{step}")


def near_pairs(ws: Workspace, words: DataFrame) -> DataFrame:
    """All near pairs (a, b), each in both orders."""
    forward = _near_one_way(ws, words.select("word"), "forward")
    back = _near_one_way(ws, words.select(F.reverse("word").alias("word")), "reverse")
    once = forward.unionAll(back.select(F.reverse("a").alias("a"), F.reverse("b").alias("b")))
    both = once.unionAll(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.distinct()


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form), by doubling the
    steps until no root has a form."""
    at, step = ws.put(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = at.join(hop, "root", "left")
        step += 1
        out = ws.put(longer.select("word", F.coalesce("next", "root").alias("root"),
                                   F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        if out.filter("moved").isEmpty():
            return out.select("word", "root")
        at = out.select("word", "root")


def group_variants(spark: SparkSession, words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for the distinct words (word, n)."""
    ws = Workspace(spark, "spelling")
    words = ws.put(words.select("word", "n"), "words")
    named = near_pairs(ws, words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = ws.put(named.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b"))).alias("top")), "near")
    out = words.join(best, "word", "left")
    out = ws.put(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(-F.col("top.minus") >= ratio * F.col("n"), F.col("top")).alias("top")), "formed")
    out = out.select("word", "n", "n_near", F.col("top.b").alias("form"), (-F.col("top.minus")).alias("form_n"))
    ends = roots(ws, out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op13: word, form, root, n, n_near, form_n."""
    return group_variants(spark, vocabulary(docs))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
keyed AS (SELECT DISTINCT doc_id, run FROM runs WHERE doc_id IS NOT NULL),
bytes AS (
  SELECT doc_id, run, list_transform(range(octet_length(raw)), lambda i:
           ('0x' || substr(hex(raw), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT doc_id, run, encode(doc_id || ':' || run) AS raw FROM keyed)),
crc_steps AS (
  SELECT doc_id, run, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, k:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM bytes),
h AS (SELECT doc_id, run, xor(c, 4294967295) AS h FROM crc_steps),
slipped AS (
  SELECT CASE WHEN h % 31 = 0
              THEN substr(r.run, 1, (h % length(r.run))::INT) || substr(r.run, (h % length(r.run))::INT + 2)
              ELSE r.run END AS word
  FROM runs r LEFT JOIN h ON r.doc_id = h.doc_id AND r.run = h.run),
words AS (SELECT word, count(*)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
masks AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS b_n FROM masks a JOIN masks b ON a.i = b.i AND a.less = b.less
    AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT m.word, w.word, w.n FROM masks m JOIN words w ON m.less = w.word
  UNION SELECT w.word, m.word, m.n FROM masks m JOIN words w ON m.less = w.word),
tops AS (
  SELECT a, count(*)::BIGINT AS n_near, (list({'w': b, 'n': b_n} ORDER BY b_n DESC, encode(b)))[1] AS top
  FROM pairs GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN top.n >= 10 * n THEN top.w END AS form, CASE WHEN top.n >= 10 * n THEN top.n END AS form_n
  FROM words LEFT JOIN tops ON word = a),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NOT NULL),
ends AS (
  SELECT chain.word, chain.root FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends ON formed.word = ends.word
"""
