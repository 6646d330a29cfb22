"""Text functions (F1–F3, F6–F8) as built-in column expressions.

No Python runs per row: cleaning is a chain of ``regexp_replace``,
segmentation is a ``split`` plus an ``aggregate`` fold inside the row, token
counts are ``split`` + ``filter``. Whitespace follows the Unicode rules of
Python's ``str`` methods (Java's plain ``\\s`` is ASCII only), so the class
is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: characters Python's str.isspace() treats as whitespace ---
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex class: Java's Unicode \s plus the four separators
# U+001C..U+001F (used with the (?U) flag at the start of a Spark pattern) ...
WS_SPARK = r"[\s\x1C-\x1F]"
# ... and spelled out for engines without Unicode classes (the SQL oracle).
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
# --- fixed values: cleaning patterns and tokens ---
REDACTION_PATTERN = r"\[\*\*[^\]]+\*\*\]"
REDACTION_TOKEN = " [REDACTED] "
SPECIAL_CHARS_PATTERN = f"[^a-zA-Z0-9{WS_CLASS}.,:;\\-]"
SPARK_SPECIAL_CHARS = r"(?U)[^a-zA-Z0-9\s\x1C-\x1F.,:;\-]"
SPARK_WS_RUN = f"(?U){WS_SPARK}+"
SPARK_SENTENCE_SPLIT = f"(?U)(?<=[.!?]){WS_SPARK}+"
SPARK_TOKEN = r"(?U)[^\s\x1C-\x1F]+"
KEYWORD_PATTERN = r"(?U)\b[a-z]{4,}\b"
CHARS_PER_TOKEN = 4


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a character-set trim, no regex)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def clean_text(c: str | Column, remove_special_chars: bool = False, lowercase: bool = False) -> Column:
    """null → ''; redaction markers → ' [REDACTED] '; whitespace runs → one
    space; optional strip of special characters; optional lower case; trim.
    Order matters: the special-character strip also removes the brackets of
    the redaction token."""
    t = F.coalesce(_c(c), F.lit(""))
    t = F.regexp_replace(t, REDACTION_PATTERN, REDACTION_TOKEN)
    t = F.regexp_replace(t, SPARK_WS_RUN, " ")
    if remove_special_chars:
        t = F.regexp_replace(t, SPARK_SPECIAL_CHARS, "")
    if lowercase:
        t = F.lower(t)
    return strip_ws(t)


def _greedy_cuts(lengths: Column, limit: int) -> Column:
    """Positions (from 0) at which a new segment begins, and the end. The open
    segment's size is its last prefix sum less the one before its first
    sentence, kept as one running number: a sentence joins while that and its
    own length stay within the limit, and then counts with the blank before it."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["size"] + n <= limit
        return F.struct(
            F.when(fits, acc["size"] + n + 1).otherwise(n).alias("size"), (acc["at"] + 1).alias("at"),
            F.when(fits & (acc["at"] > 0), acc["cuts"]).otherwise(F.array_append(acc["cuts"], acc["at"])).alias("cuts"))

    return F.aggregate(lengths, start, step, lambda acc: F.array_append(acc["cuts"], acc["at"]))


def segment_text(c: str | Column, max_tokens: int = 512) -> Column:
    """text of at most ``max_tokens``·4 characters → one segment; longer
    text is split after sentence ends and packed greedily; a sentence longer
    than the limit stays whole. The cuts are found on the sentence lengths
    alone, then every segment is sliced and joined once, so the work is linear
    in the text."""
    t = _c(c)
    max_chars = max_tokens * CHARS_PER_TOKEN
    sentences = F.split(t, SPARK_SENTENCE_SPLIT)

    def sliced(parts: Column) -> Column:
        cuts = F.array(_greedy_cuts(F.transform(parts, F.length), max_chars))
        return F.flatten(F.transform(cuts, lambda at: F.transform(
            F.sequence(F.lit(0), F.size(at) - 2),
            lambda i: strip_ws(F.array_join(F.slice(parts, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i)), " ")))))

    packed = F.flatten(F.transform(F.array(sentences), sliced))  # the sentences are split once
    return F.when(t.isNull(), F.lit(None).cast("array<string>")) \
            .when(F.length(t) <= max_chars, F.array(t)).otherwise(packed)


def token_count(c: str | Column) -> Column:
    """Python ``len(s.split())``: the number of maximal non-whitespace
    runs (one regex pass, no array), 0 for ''."""
    return F.regexp_count(_c(c), F.lit(SPARK_TOKEN))


def keywords(c: str | Column) -> Column:
    """F8: lower-cased words of four or more ASCII letters bounded by
    (Unicode) word boundaries."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(KEYWORD_PATTERN), 0)


def complaint_text(c: str | Column, max_chars: int = 100) -> Column:
    """pipes become ';', then the first ``max_chars`` characters."""
    return F.substring(F.replace(_c(c).cast("string"), F.lit("|"), F.lit(";")), 1, max_chars)
