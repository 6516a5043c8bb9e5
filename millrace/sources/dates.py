"""Standard dates in text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import DATE_NAME_KEYWORDS
from ..frame import aggregate_row, chunks, col, is_text, require_columns
from ..functions.dates import standard_date

USUAL_SHARE, NAMED_SHARE = 0.5, 0.2


def fit_date_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Text columns of which most cells, or a fifth if the name says date, are dates."""
    require_columns(df, columns)
    texts = [c for c in columns or df.columns if is_text(df, c)]
    chosen = []
    for part in chunks(texts, 25):
        dated = lambda c: F.avg(F.when(col(c).isNotNull(), standard_date(col(c)).isNotNull().cast("double")))
        shares = aggregate_row(df, {c: dated(c) for c in part})
        for c in part:
            named = any(k in c.lower() for k in DATE_NAME_KEYWORDS)
            share = shares[c] or 0.0
            if share > USUAL_SHARE or (named and share > NAMED_SHARE):
                chosen.append(c)
    return chosen


def apply_date_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Write dates as ``yyyy-MM-dd``; other cells keep their text."""
    return df.withColumns({c: F.coalesce(standard_date(col(c)), col(c)) for c in columns}) if columns else df


def standardise_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return apply_date_columns(df, fit_date_columns(df, columns))
