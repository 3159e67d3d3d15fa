"""Text expressions shared by rules, fixers and statistics; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character class of word characters, and zero-width word borders, for all scripts.
W = r"[\p{L}\p{N}_]"
LEFT, RIGHT = rf"(?<!{W})", rf"(?!{W})"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\s+$", "")


def blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def collapse(c: Column | str) -> Column:
    """Lower case with single spaces, for comparing headings."""
    return F.lower(strip(F.regexp_replace(_c(c), r"(?U)\s+", " ")))


def words(c: Column | str) -> Column:
    """Number of words, counted between white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(_c(c), r"(?U)\s+", -1), lambda x: x != "")), F.lit(0))


def preview(c: Column | str, n: int = 50) -> Column:
    """The first *n* characters, with an ellipsis when there are more."""
    s = strip(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def text_of(parts: Column | str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Texts of an array of inline elements joined; by default those of kind text."""
    test = keep or (lambda r: r["kind"] == "text")
    return F.array_join(F.transform(F.filter(_c(parts), test), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def count(c: Column | str, pattern: str) -> Column:
    """Matches of a pattern; null has none."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(pattern)), F.lit(0))


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a group, in order; null has none."""
    return F.coalesce(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def number(c: Column | str) -> Column:
    """Integer in a string, else null."""
    return strip(c).try_cast("int")
