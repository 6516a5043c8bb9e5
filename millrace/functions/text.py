"""Text case and format matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import FORMAT_PATTERNS


def title_case(c: Column) -> Column:
    """Upper first letter of every run of letters, lower rest: ``o'neil`` -> ``O'Neil``.

    ``initcap`` only starts a word after a blank, so runs of letters and of
    non-letters are taken apart and joined again.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(runs, capital), "")


def change_case(c: Column, case: str) -> Column:
    if case not in ("lower", "upper", "title"):
        raise ValueError(f"unknown case {case!r}")
    return {"lower": F.lower, "upper": F.upper, "title": title_case}[case](c)


def matches_format(c: Column, format_type: str, pattern: str | None = None) -> Column:
    """True where the text form of the value has the format; false for null.

    Custom patterns are anchored at the start only. ``(?U)`` makes the digit and
    space classes cover Unicode.
    """
    regex = FORMAT_PATTERNS.get(format_type) or pattern or ".*"
    return F.coalesce(c.cast("string").rlike(f"(?U)^(?:{regex})"), F.lit(False))
