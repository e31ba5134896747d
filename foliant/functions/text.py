"""Scalar expressions over text, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_first(text: Column, word: str) -> Column:
    """The offset of the first occurrence, -1 if none."""
    return (F.instr(text, word) - 1).cast("bigint")


def find_last(text: Column, word: str) -> Column:
    """The offset of the last occurrence, -1 if none."""
    at = F.instr(F.reverse(text), word[::-1])
    return F.when(at > 0, F.length(text) - at - len(word) + 1).otherwise(-1).cast("bigint")


def size_text(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal, base 1024, ties upward."""
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(tenth(n / 1024), F.lit(" KB"))).otherwise(F.concat(tenth(n / 1048576), F.lit(" MB")))


def escaped(text: Column) -> Column:
    """Backslash, then both parentheses, behind a backslash: the literal-string form."""
    for c in "\\()":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, r"\\([\\()])", "$1")


def literal_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss")


def readable_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS as Y/M/D h:m:s; anything else only loses a leading D:."""
    shape = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}).*$"
    return F.when(text.rlike(shape), F.regexp_replace(text, shape, "$1/$2/$3 $4:$5:$6")).otherwise(F.regexp_replace(text, "^D:", ""))


def utf16_literal(text: Column) -> Column:
    """ASCII as an escaped literal, other text as a hexadecimal string with a byte-order mark."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.concat(F.lit("("), escaped(text), F.lit(")"))).otherwise(F.concat(F.lit("<feff"), F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit(">")))


def is_blank(text: Column) -> Column:
    """Nothing but white space in the wide sense: ASCII controls, line and paragraph separators, the byte-order mark, all of Zs."""
    return F.regexp_replace(text, r"[\t\n\x0B\f\r  ﻿\p{Zs}]", "") == ""


def fixed_width(value: Column, digits: int) -> Column:
    return F.lpad(value.cast("string"), digits, "0")


def big_endian(hex_text: Column, first: int, n: int) -> Column:
    """A number from ``n`` hexadecimal digits, counted from 1."""
    return F.conv(F.substring(hex_text, first, n), 16, 10).cast("bigint")
