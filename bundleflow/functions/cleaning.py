"""Cleaning of all-string registry cells: blanks, numbers, dates, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values --------------------------------------------------------------------
BLANKS = ("", "nan", "nat", "none", "null", "<na>")
NO_DATE_SENTINELS = ("01/01/1900", "1900-01-01", "1900-01-01 00:00:00", "1900-01-01 00:00:00.000000")
# Accepted date shapes, tried in this order.
DATE_PATTERNS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s.SSSSSS"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
)
DEVANAGARI_DIGITS = "०१२३४५६७८९"
# -------------------------------------------------------------------------------------

# Whitespace as Unicode text handling understands it; Spark's plain trim strips U+0020 only.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_NON_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)$"
_INT8_EDGE = 9.223372036854775807e18


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


HEADER_SEPARATORS = "-/\\"


def norm_header_name(name: str) -> str:
    """Plan-time header normalisation, used on ``df.columns``.

    Letters, digits and underscores stay; each run of separators becomes one underscore.
    """
    kept, in_gap = [], False
    for letter in name.strip().lower():
        gap = letter.isspace() or letter in HEADER_SEPARATORS
        if gap and not in_gap:
            kept.append("_")
        elif letter.isalnum() or letter == "_":
            kept.append(letter)
        in_gap = gap
    return "".join(kept)


def norm_header(c: Column) -> Column:
    """The same normalisation for a column that holds header names."""
    joined = F.regexp_replace(F.lower(strip(c)), r"(?U)[\s\-/\\]+", "_")
    return F.regexp_replace(joined, r"(?U)[^\w]", "")


def blank_to_null(c: Column) -> Column:
    """Stripped text, or null for the blank spellings (matched case-sensitively)."""
    s = strip(c)
    return F.when(~s.isin(*BLANKS), s)


strip_text = blank_to_null


def devanagari_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def _number(c: Column) -> Column:
    """Text to double under the guard; null for everything that is not a plain number."""
    s = devanagari_digits(blank_to_null(c))
    return F.when(s.rlike(_NUMBER), F.translate(s, "_", "").try_cast("double"))


def to_int4(c: Column) -> Column:
    return _number(c).try_cast("int")


def to_int8(c: Column) -> Column:
    """Goes through double on purpose: values above 2^53 round the same way."""
    d = _number(c)
    return F.when((d < F.lit(_INT8_EDGE)) & (d >= F.lit(-_INT8_EDGE)), d.try_cast("bigint"))


def to_float(c: Column) -> Column:
    s = blank_to_null(c)
    special = F.when(s.rlike(_NON_FINITE), F.regexp_replace(F.lower(s), "^[+-](?=nan)", "").try_cast("double"))
    return F.coalesce(_number(c), special).cast("float")


def safe_int(c: Column) -> Column:
    """Half-even rounding of a number in text; 0 when it is not a number."""
    return F.coalesce(F.bround(_number(c.cast("string"))).try_cast("int"), F.lit(0))


def sentinel_to_null(c: Column) -> Column:
    s = blank_to_null(c)
    return F.when(~s.isin(*NO_DATE_SENTINELS), s)


def parse_timestamp(c: Column) -> Column:
    """First matching date shape wins.

    The shape test comes first so the parser, which signals failure by an exception, only
    runs on text that can parse.
    """
    s = F.regexp_replace(sentinel_to_null(c), r"(?<=\d)\s+(?=\d)", " ")
    return F.coalesce(
        *[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) for shape, fmt in DATE_PATTERNS]
    )


def parse_date_text(c: Column) -> Column:
    return F.date_format(parse_timestamp(c), "yyyy-MM-dd")


def lower_or_empty(c: Column) -> Column:
    return F.coalesce(F.lower(blank_to_null(c)), F.lit(""))


def full_name(*parts: Column) -> Column:
    """Lower-case parts, blanks skipped, joined by one space; '' when all are blank."""
    return F.concat_ws(" ", *[F.lower(blank_to_null(p)) for p in parts])


def default_fill(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
