"""Number-to-text formatting that matches Python's printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_decimal(c: str | Column) -> Column:
    """Python ``f"{x:.1f}"``. ``format_number`` rounds the exact binary
    value half-even like Python does, but adds thousands separators, which
    are removed."""
    return F.replace(F.format_number(_c(c).cast("double"), 1), F.lit(","), F.lit(""))


def py_str(c: str | Column) -> Column:
    """Python ``str(float)`` for a double. Both print the shortest digits
    that read back as the value; Java switches to ``d.dddEn`` from 1e7 and
    below 1e-3, Python to ``d.ddde+nn`` from 1e16 and below 1e-4, so Java's
    exponent form is taken apart and printed by Python's rules. In between (and
    for 0) both print the same, which is tested first."""
    x = _c(c).cast("double")
    same = (x == 0) | ((F.abs(x) >= F.lit(1e-3)) & (F.abs(x) < F.lit(1e7)))
    java = F.abs(x).cast("string")
    sign = F.when(java.isNotNull() & F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    exp = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    mantissa = F.split_part(java, F.lit("E"), F.lit(1))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0$", "")
    rest = F.substr(digits, F.lit(2))
    whole = F.concat(F.rpad(F.substr(digits, F.lit(1), exp + 1), exp + 1, F.lit("0")), F.lit("."),
                     F.when(F.length(digits) > exp + 1, F.substr(digits, exp + 2)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    power = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest))
                     .otherwise(""), F.when(exp < 0, "e-").otherwise("e+"),
                     F.lpad(F.abs(exp).cast("string"), F.greatest(F.length(F.abs(exp).cast("string")), F.lit(2)),
                            F.lit("0")))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(same, x.cast("string")) \
            .when(F.isnan(x), "nan").when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("inf"))) \
            .when(exp.isNull(), F.concat(sign, java)) \
            .when((exp >= 0) & (exp < 16), F.concat(sign, whole)) \
            .when((exp < 0) & (exp >= -4), F.concat(sign, small)) \
            .otherwise(F.concat(sign, power))


def opens_dict(value: str | Column) -> Column:
    return F.startswith(F.ltrim(_c(value).cast("string")), F.lit("{"))


def dict_parts(value: str | Column) -> Column:
    """a serialized flat dict → array of ``"k: v"`` strings in key order
    of the text; null when it is not a flat dict. JSON is parsed as it stands;
    what is not JSON is read as a Python literal: its quoted strings become
    JSON strings, and ``None``, ``True`` and ``False`` stay as Python prints
    them."""
    raw = _c(value).cast("string")
    # a quoted string: '...' or "..." without its own quote or escapes
    quoted = F.regexp_replace(raw, r"""'([^'"\\]*)'(?=\s*[:,}])""", '"$1"')
    literal = F.regexp_replace(quoted, r"""(?<=[:\s])(None|True|False)(?=\s*[,}])""", '"$1"')
    as_json = F.from_json(raw, "map<string,string>", {"allowSingleQuotes": "false"})
    parsed = F.when(opens_dict(raw), F.coalesce(as_json, F.from_json(literal, "map<string,string>")))
    return F.transform(F.map_entries(parsed), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
