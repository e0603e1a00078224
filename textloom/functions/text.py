"""Scalar column functions over strings."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import Normalizer

OMITTED = "∅"


@lru_cache(None)
def accent_table() -> tuple[str, str]:
    """Characters with diacritics and their bases, by canonical decomposition."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] != "L" or 0xAC00 <= code <= 0xD7A3:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    source, target = accent_table()
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), source, target)


def normalize_word(c: Column, n: Normalizer) -> Column:
    """Case, then accents, then the spelling table."""
    out = F.lower(c) if n.lowercase else c
    out = strip_accents(out) if n.strip_accents else out
    if n.spelling:
        table = F.create_map(*[F.lit(x) for pair in sorted(n.spelling.items()) for x in pair])
        out = F.coalesce(F.try_element_at(table, out), out)
    return out


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units, the unit of all character offsets."""
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def cite(page: Column, line: Column, end_line: Column, first_word: Column, last_word: Column) -> Column:
    """``p.1 · line 2 · words 3–4``: one-based page, lines and words of a place."""
    same_line = line == end_line
    words = F.when(first_word == last_word, F.format_string("word %d", first_word + 1)).otherwise(F.format_string("words %d–%d", first_word + 1, last_word + 1))
    one = F.concat(F.format_string("p.%d · line %d · ", page + 1, line + 1), words)
    many = F.format_string("p.%d · lines %d–%d · words %d…%d", page + 1, line + 1, end_line + 1, first_word + 1, last_word + 1)
    return F.when(same_line, one).otherwise(many)


def shown(c: Column) -> Column:
    """A reading, or the omission sign for an empty one."""
    return F.when(F.coalesce(c, F.lit("")) == "", OMITTED).otherwise(c)


def csv_quote(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def insertion_key(c: Column) -> Column:
    """Lower case with blanks collapsed: insertions that read alike are one."""
    return F.trim(F.regexp_replace(F.lower(c), " +", " "))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def percent(c: Column) -> Column:
    """One decimal, none if it is zero."""
    tenths = F.round(c * 10) / 10
    return F.concat(F.when(tenths == F.round(tenths), F.format_string("%d", F.round(tenths).cast("long"))).otherwise(F.format_string("%.1f", tenths)), F.lit("%"))
