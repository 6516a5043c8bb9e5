"""Lag and rolling features, and fills along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frame import aggregate_row, col, nullify_nan, require_columns, require_numeric
from .ordered import fill_along, over_preceding

STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda c: F.percentile(c, 0.5),
}


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns or [])


def create_lag_features(df: DataFrame, column: str, lags: list[int], order_by,
                        partition_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``{column}_lag_{n}``: the value n rows earlier in the order."""
    require_numeric(df, [column])
    if any(n < 1 for n in lags):
        raise ValueError("lags must be at least 1")
    steps = sorted(set(lags))
    columns = lambda w: {f"{column}_lag_{n}": F.lag(col(column), n).over(w) for n in steps}
    return over_preceding(df, steps[-1], columns, _names(partition_by), _names(order_by), rows_per_bucket)


def lag_nulls(df: DataFrame, columns: list[str]) -> int:
    """Nulls that the lag columns hold."""
    counts = aggregate_row(df, {c: F.count_if(col(c).isNull()) for c in columns})
    return sum(counts.values())


def create_rolling_features(df: DataFrame, column: str, windows: list[int], order_by,
                            stats: list[str] | None = None, min_periods: int = 1, partition_by=None,
                            rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``{column}_rolling_{n}_{stat}`` over the last n rows.

    A result is null while fewer than ``min_periods`` cells of the frame hold a
    value.
    """
    require_numeric(df, [column])
    stats = ["mean", "std"] if stats is None else stats
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"unknown stats {unknown}")
    sizes = sorted(set(windows))

    def columns(w):
        out = {}
        for n in sizes:
            frame = w.rowsBetween(-(n - 1), 0)
            enough = F.count(col(column)).over(frame) >= min_periods
            for s in stats:
                out[f"{column}_rolling_{n}_{s}"] = F.when(enough, STATS[s](col(column)).over(frame))
        return out

    clean = nullify_nan(df, [column])
    return over_preceding(clean, sizes[-1] - 1, columns, _names(partition_by), _names(order_by), rows_per_bucket)


def time_series_fill(df: DataFrame, columns: list[str], order_by, method: str = "ffill",
                     partition_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """Fill nulls with the previous (ffill) or next (bfill) value in the order."""
    require_columns(df, columns)
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown method {method!r}")
    clean = nullify_nan(df, columns)
    return fill_along(clean, columns, method == "bfill", _names(partition_by), _names(order_by), rows_per_bucket)
