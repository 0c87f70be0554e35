"""Numerals, XML text, offsets and rounding as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Roman numerals of each digit, by place.
_ROMAN = (
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
)


def letters(n: Column) -> Column:
    """a to z, then aa, bb and on; empty below one."""
    n = n.cast("long")
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(n - 1, F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.when(n < 1, "").otherwise(F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int")))


def roman(n: Column) -> Column:
    """Lower-case Roman numerals with any number of thousands; empty below one."""
    n = n.cast("long")
    digits = [F.element_at(F.array(*map(F.lit, row)), (F.floor(n / place) % 10 + 1).cast("int")) for row, place in zip(_ROMAN, (100, 10, 1), strict=True)]
    return F.when(n < 1, "").otherwise(F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), *digits))


def numeral(n: Column, style: Column) -> Column:
    """A number in one of the list and page styles; unknown styles are decimal."""
    return (
        F.when(style == "lowerLetter", letters(n))
        .when(style == "upperLetter", F.upper(letters(n)))
        .when(style == "lowerRoman", roman(n))
        .when(style == "upperRoman", F.upper(roman(n)))
        .otherwise(n.cast("long").cast("string"))
    )


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def _replaced(s: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, s)


#: What XML text and attributes escape, in order of replacement.
_TEXT = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
_ATTRIBUTE = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))


def xml_text(s: Column) -> Column:
    return _replaced(s, _TEXT)


def xml_attribute(s: Column) -> Column:
    return _replaced(s, _ATTRIBUTE)


def svg_number(x: Column) -> Column:
    """Three decimals, rounded half up, without trailing zeros."""
    n = F.floor(x * 1000 + 0.5).cast("long")
    sign, a = F.when(n < 0, "-").otherwise(""), F.abs(n)
    tail = F.regexp_replace(F.lpad((a % 1000).cast("string"), 3, "0"), "0+$", "")
    return F.concat(sign, F.floor(a / 1000).cast("string"), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)))
