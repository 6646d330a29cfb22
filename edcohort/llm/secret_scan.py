"""Secret scans: fixed formats plus a randomness test battery, native
DataFrame functions only.

Base kinds are found in whole texts, leftmost and non-overlapping per kind:
``assign`` (a key word, ``:`` or ``=``, a value of 6+ characters), ``access``
(``AKIA...`` of 20+), ``hex`` (runs of 24+). The method adds the kind
``random``: runs of 16+ characters of ``[A-Za-z0-9+/_-]`` (and one or two ``=``
where they end a run) outside all base spans that look drawn at random and do
not look like words. A run is tested as a whole and, if ``-`` or ``_`` cut it
into parts, so are its parts of 16+ characters; parts of a run that is a secret
as a whole are not listed again.

Battery, per unit with a digit and a letter, on the positions of its characters
in the alphabet of its inferred encoding (hex, base32, base36, base64):
* chi-squared of the character counts against a uniform alphabet;
* number of runs of the lower and upper half of the alphabet;
* serial correlation of neighbours.
The smallest of the three p-values, times three, is the p-value of "drawn at
random". The opposite hypothesis, "made of words and numbers", is tested by how
rare the letters are in words and by how often word, number or capital pieces
change (for hex: by all letters lying in a-f).

A secret is a unit whose randomness is not rejected and whose wordiness is.
Both rejections follow Benjamini-Hochberg at ``FDR`` within each length class
(powers of two), since short units give weak evidence and would otherwise set
the cut for long ones: the second one bounds the share of false secrets. Units
below ``MIN_BITS`` of alphabet bits, without a digit or a letter, or in no known
encoding are not tested; runs without any tested unit are counted per document.

Plan: pass 1 tests the candidate units row by row and counts them by (length
class, two p-value bins), at most 32 x 64 x 128 counts whatever the input, from
which the cuts follow. Pass 2 finds and judges all spans row by row with the
cuts as constants. No text is shuffled, no row depends on another, and a hot key
cannot arise.

Defined cases: a null text counts as empty and has no spans; an empty table
gives an empty result; repeated rows and ties give the same spans each; spans
of different kinds may overlap and all stay; further columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
RUN = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
PART = r"([A-Za-z0-9+/]{16,}(?:=+$)?)"
PIECE = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
MIN_VALUE = 6
MIN_BITS = 80.0
FDR = 0.05
BINS = 64
WORD_BINS = 128
#: Share of neighbours in ordinary names where a word, number or capital piece ends.
PIECE_RATE = 0.25
#: Letters a to z in English text, per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
           6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Letters rarer than this (per cent) count as this rare.
RAREST = 0.5
#: p-value bins per power of ten.
PER_DECADE = 8
MASK = "[SECRET]"
#: Alphabets by inferred encoding, in the order they are tried.
ALPHABETS = (
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _found(text: Column, pattern: str, kind: int, min_value: int = 0) -> Column:
    """array<SPAN> of the matches whose group 1 has ``min_value`` characters.
    What lies between the matches gives their places."""
    def placed(found: Column) -> Column:
        gaps, hits, values = found["gaps"], found["hits"], found["values"]
        lengths = F.transform(hits, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))
        return let(prefix_sums(lengths), lambda before: F.filter(
            F.transform(hits, lambda m, i: F.when(
                F.char_length(F.get(values, i)) >= min_value,
                F.struct((F.get(before, i) + F.char_length(F.get(gaps, i))).alias("start"),
                         F.lit(kind).alias("kind"),
                         (F.get(before, i) + F.char_length(F.get(gaps, i)) + F.char_length(m)).alias("end")))),
            lambda s: s.isNotNull()))

    p = F.lit(pattern)
    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"),
                     F.regexp_extract_all(text, p, F.lit(1)).alias("values"))
    return F.when(F.rlike(text, p), let(parts, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(_found(text, ASSIGN, 0, MIN_VALUE), _found(text, ACCESS, 1), _found(text, HEX, 2))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal: up to 7 % too large below 0.5, and
    its complement above."""
    def upper(x: Column) -> Column:
        return F.exp(-x * x / 2.0) * (2.0 / math.sqrt(2.0 * math.pi)) / (x + F.sqrt(x * x + 8.0 / math.pi))

    return let(F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0)),
               lambda x: F.when(x >= 0, upper(x)).otherwise(1.0 - upper(-x)))


def _p_value(x: Column, k: int) -> Column:
    """Of "drawn uniformly from k characters", for positions x of n > 1."""
    n = F.size(x).cast("double")
    zero = F.lit(0.0)

    def add(a: Column, v: Column) -> Column:
        return a + v

    squares = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                      lambda c: F.pow(F.size(F.filter(x, lambda v: v == c)), F.lit(2.0))), zero, add)
    chi = squares * k / n - n
    z_chi = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    steps = F.sequence(F.lit(0), F.size(x) - 2)
    changes = F.aggregate(F.transform(steps, lambda i: (
        (F.get(x, i) < k // 2) != (F.get(x, i + 1) < k // 2)).cast("double")), zero, add)
    z_runs = (2.0 * changes - (n - 1)) / F.sqrt(n - 1)
    mid, var = (k - 1) / 2.0, (k * k - 1) / 12.0
    products = F.aggregate(F.transform(steps, lambda i: (F.get(x, i) - mid) * (F.get(x, i + 1) - mid)), zero, add)
    z_serial = products / (var * F.sqrt(n - 1))
    return F.least(F.lit(1.0), 3.0 * F.least(_tail(z_chi), 2.0 * _tail(F.abs(z_runs)), 2.0 * _tail(F.abs(z_serial))))


def _word_p_value(body: Column, is_hex: Column) -> Column:
    """Of "made of words and numbers": small for letters rarer, and pieces
    shorter, than in words; for hex by letters that all lie in a-f."""
    share = [f / sum(LETTERS) for f in LETTERS]
    rare = [-math.log(max(f, RAREST / 100.0)) for f in share]
    mean = sum(f * r for f, r in zip(share, rare))
    sd = math.sqrt(sum(f * (r - mean) ** 2 for f, r in zip(share, rare)))
    table = F.array(*[F.lit(r - mean) for r in rare])
    letters = F.filter(F.transform(F.split(F.lower(body), ""), lambda c: F.instr(
        F.lit("abcdefghijklmnopqrstuvwxyz"), c) - 1), lambda v: v >= 0)
    steps = (F.char_length(F.regexp_replace(body, "[^A-Za-z0-9]", "")) - 1).cast("double")
    pieces = (F.size(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0))) - 1).cast("double")
    z_pieces = (pieces - steps * PIECE_RATE) / F.sqrt(steps * (PIECE_RATE * (1.0 - PIECE_RATE)))

    def judged(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.get(table, v))
        z_letters = total / (sd * F.sqrt(F.size(x).cast("double")))
        return F.when(is_hex, F.pow(F.lit(sum(share[:6])), F.size(x))).otherwise(
            _tail((z_letters + z_pieces) / math.sqrt(2.0)))

    return let(letters, judged)


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(-F.log10(p) * PER_DECADE).cast("int"), F.lit(bins - 1))


def _battery(unit: Column) -> Column:
    """struct<random, words>: the bins of a unit's two p-values; null where it
    has no digit or no letter, no encoding fits or it has too few bits."""
    body = F.translate(F.rtrim(unit, F.lit("=")), "-_", "+/")

    def tested(b: Column, alphabet: str) -> Column:
        k = len(alphabet)
        s = F.lower(b) if k == 16 else b
        places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        p = let(F.filter(places, lambda v: v >= 0), lambda x: _p_value(x, k))
        return F.when(F.char_length(b) * math.log2(k) >= MIN_BITS, p)

    def judged(b: Column) -> Column:
        p = F.lit(None).cast("double")
        for pattern, alphabet in reversed(ALPHABETS):
            p = F.when(F.rlike(b, F.lit(pattern)), tested(b, alphabet)).otherwise(p)
        words = _word_p_value(b, F.rlike(b, F.lit(ALPHABETS[0][0])))
        return let(p, lambda q: F.when(q.isNotNull(), F.struct(
            _bin(q, BINS).alias("random"), _bin(words, WORD_BINS).alias("words"))))

    return F.when(F.rlike(unit, F.lit("[0-9]")) & F.rlike(unit, F.lit("[A-Za-z]")), let(body, judged))


def _length_class(length: Column) -> Column:
    return F.least(F.floor(F.log2(length.cast("double"))).cast("int"), F.lit(31))


WHOLE, PARTIAL = 0, 1
UNIT = "struct<run:bigint,whole:boolean,start:bigint,end:bigint,klass:int,bins:struct<random:int,words:int>>"


def _units(text: Column, run: Column) -> Column:
    """array<UNIT> of one run: the whole, then its parts."""
    def unit(s: Column, place: Column) -> Column:
        length = place["end"] - place["start"]
        start = run["start"] + place["start"]
        part = F.substring(s, (place["start"] + 1).cast("int"), length.cast("int"))
        return F.struct(run["start"].alias("run"), (place["kind"] == WHOLE).alias("whole"), start.alias("start"),
                        (start + length).alias("end"), _length_class(length).alias("klass"),
                        let(part, _battery).alias("bins"))

    def cut(s: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(WHOLE).alias("kind"),
                                 F.char_length(s).cast("bigint").alias("end")))
        places = F.when(F.rlike(s, F.lit("[-_]")), F.concat(whole, _found(s, PART, PARTIAL))).otherwise(whole)
        return F.transform(places, lambda place: unit(s, place))

    return let(F.substring(text, (run["start"] + 1).cast("int"), (run["end"] - run["start"]).cast("int")), cut)


def _random_runs(text: Column, base: Column) -> Column:
    """array<array<UNIT>>: per run outside the base spans its units; those not
    tested have null ``bins``."""
    def outside(spans: Column) -> Column:
        runs = F.filter(_found(text, RUN, 3), lambda r: ~F.exists(
            spans, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
        return F.transform(runs, lambda r: _units(text, r))

    return F.when(F.rlike(text, F.lit(RUN)), let(base, outside)).otherwise(
        F.array().cast(f"array<array<{UNIT}>>"))


def _rejected(in_bin: dict[int, int], total: int, bins: int) -> int:
    """First p-value bin that Benjamini-Hochberg rejects among ``total`` tests
    (``bins`` if none)."""
    cut, below = bins, 0
    for b in range(bins - 1, -1, -1):
        below += in_bin.get(b, 0)
        # a bin's largest p-value is at its lower edge
        if below and 10.0 ** (-b / PER_DECADE) <= FDR * below / total:
            cut = b
    return cut


def random_cuts(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """Length class -> (first bin at which randomness is rejected, first bin at
    which words are): Benjamini-Hochberg over all units of the class, for words
    counting as evidence only units still taken as random. Counts by class and
    bins are all that reaches the driver."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = docs.filter(F.rlike(text, F.lit(RUN))).select(text.alias("text")).select(
        F.explode(F.flatten(_random_runs(F.col("text"), base_spans(F.col("text"))))).alias("u"))
    counts = units.filter("u.bins IS NOT NULL").groupBy(
        F.col("u.klass").alias("klass"), F.col("u.bins.random").alias("random"),
        F.col("u.bins.words").alias("words")).agg(F.count(F.lit(1)).alias("n")).collect()
    cuts: dict[int, tuple[int, int]] = {}
    for klass in {c["klass"] for c in counts}:
        rows = [c for c in counts if c["klass"] == klass]
        total = sum(c["n"] for c in rows)
        by_random: dict[int, int] = {}
        for c in rows:
            by_random[c["random"]] = by_random.get(c["random"], 0) + c["n"]
        random = _rejected(by_random, total, BINS)
        by_words: dict[int, int] = {}
        for c in rows:
            if c["random"] < random:
                by_words[c["words"]] = by_words.get(c["words"], 0) + c["n"]
        cuts[klass] = (random, _rejected(by_words, total, WORD_BINS))
    return cuts


def all_found(text: Column, cuts: dict[int, tuple[int, int]]) -> Column:
    """struct<spans: array<SPAN> of every kind by start and kind, untested: runs
    without a tested unit>."""
    def cut(klass: Column, which: int, none: int) -> Column:
        out = F.lit(none)
        for k, pair in sorted(cuts.items()):
            out = F.when(klass == k, F.lit(pair[which])).otherwise(out)
        return out

    def secret(u: Column) -> Column:
        return (u["bins"].isNotNull() & (u["bins"]["random"] < cut(u["klass"], 0, BINS))
                & (u["bins"]["words"] >= cut(u["klass"], 1, WORD_BINS)))

    def joined(base: Column) -> Column:
        def of_runs(runs: Column) -> Column:
            kept = F.transform(runs, lambda units: let(F.filter(units, secret), lambda us: F.filter(
                us, lambda u: u["whole"] | ~F.exists(us, lambda v: v["whole"]))))
            added = F.transform(F.flatten(kept), lambda u: F.struct(
                u["start"].alias("start"), F.lit(3).alias("kind"), u["end"].alias("end")))
            untested = F.filter(runs, lambda units: F.forall(units, lambda u: u["bins"].isNull()))
            return F.struct(F.array_sort(F.concat(base, added)).alias("spans"),
                            F.size(untested).cast("long").alias("untested"))

        return let(_random_runs(text, base), of_runs)

    return let(base_spans(text), joined)


def scan(docs: DataFrame, cuts: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """All columns of ``docs`` as one struct ``doc``, ``text`` (null: empty),
    ``spans`` and ``untested`` (runs that no test fits)."""
    cuts = random_cuts(docs) if cuts is None else cuts
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc", "text", all_found(F.col("text"), cuts).alias("found"))
    return found.select("doc", "text", "found.spans", "found.untested")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones joined) replaced by MASK."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")),
                         F.lit(MASK))
        fresh = s["start"] >= a["pos"]
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"),
                        F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    def end(a: Column) -> Column:
        rest = F.substring(text, (a["pos"] + 1).cast("int"), F.char_length(text))
        return F.array_join(F.concat(a["out"], F.array(rest)), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """op4: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_untested."""
    def count(kind: int) -> Column:
        return F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(F.col("spans"), lambda s: s["kind"] < 3)
    return scan(docs).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), count(3).alias("n_random"), F.col("untested").alias("n_untested"))
