"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case runs of letters and digits of at least `least` characters; null for a null text."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: F.length(t) >= least)


def source_key(source: Column) -> Column:
    """One spelling of a source: case, outer blanks and `_` for `-` don't matter."""
    return F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-"))


def lang_key(lang: Column) -> Column:
    """Two-letter language in lower case, null for unknown ones."""
    short = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(F.lower(F.trim(lang)).isin("und", ""), None).otherwise(short)


def heading(text: Column) -> Column:
    """First line that starts with one to six # and a blank, without them; null if there is none."""
    found = F.regexp_extract(text, r"(?md)^#{1,6} ([^\n]*)$", 1)
    return F.when(found != "", F.trim(found))


def snippet(text: Column, term: Column, width: int = 200, before: int = 50) -> Column:
    """About `width` characters around the first place of `term` (any case), widened to blanks, with ... where text is left out."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - before, F.lit(1))
    left = F.when(start <= 1, F.lit(1)).otherwise(start - F.coalesce(F.nullif(F.instr(F.reverse(F.substring(text, F.lit(1), start - 1)), F.lit(" ")), F.lit(0)), start) + 1)
    stop = F.least(left + width - 1, F.length(text))
    tail = F.instr(F.substring(text, stop + 1, F.length(text)), F.lit(" "))
    right = F.when(stop >= F.length(text), F.length(text)).when(tail == 0, F.length(text)).otherwise(stop + tail - 1)
    body = F.substring(text, left, right - left + 1)
    return F.concat(F.when(left > 1, "...").otherwise(""), body, F.when(right < F.length(text), "...").otherwise(""))
