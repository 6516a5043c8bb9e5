"""Outlier bounds and what to do with values beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frame import PreconditionError, aggregate_row, number, require_numeric, value
from .fits import Ask, Fit, alone

METHODS = ("iqr", "zscore", "percentile")
STRATEGIES = ("cap", "drop", "flag")


@alone
def fit_bounds(df: DataFrame, columns: list[str], method: str = "iqr", fold: float = 1.5) -> Fit:
    """(lower, upper) per column, or (None, None) for a column without values."""
    require_numeric(df, columns)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "percentile":
        if not 0 <= fold <= 0.5:
            raise PreconditionError("percentile bounds need a fold between 0 and 0.5")
        got = yield Ask(quantiles={c: [fold, 1 - fold] for c in columns})
        return {c: (got[c, fold], got[c, 1 - fold]) for c in columns}
    if method == "iqr":
        got = yield Ask(quantiles={c: [0.25, 0.75] for c in columns})
        bounds = {}
        for c in columns:
            q1, q3 = got[c, 0.25], got[c, 0.75]
            reach = None if q1 is None else fold * (q3 - q1)
            bounds[c] = (None, None) if q1 is None else (q1 - reach, q3 + reach)
        return bounds
    got = yield Ask({(c, s): f(number(df, c)) for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_samp))})
    return {c: (None, None) if got[c, "std"] is None else
            (got[c, "mean"] - fold * got[c, "std"], got[c, "mean"] + fold * got[c, "std"]) for c in columns}


def beyond(df: DataFrame, column: str, bounds: tuple):
    """True where the value lies outside its bounds; false for null."""
    lower, upper = bounds
    if lower is None:
        return F.lit(False)
    v = value(df, column)
    return F.coalesce((v < lower) | (v > upper), F.lit(False))


def apply_bounds(df: DataFrame, bounds: dict, strategy: str = "cap") -> DataFrame:
    """Cap, drop or flag values outside the bounds."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "flag":
        return df.withColumns({f"{c}_is_outlier": beyond(df, c, b).cast("int") for c, b in bounds.items()})
    if strategy == "drop":
        for c, b in bounds.items():
            df = df.filter(~beyond(df, c, b))
        return df
    capped = {}
    for c, (lower, upper) in bounds.items():
        if lower is not None:
            v = number(df, c)
            capped[c] = F.when(v < lower, F.lit(lower)).when(v > upper, F.lit(upper)).otherwise(v)
    return df.withColumns(capped) if capped else df


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr", fold: float = 1.5,
                    strategy: str = "cap") -> DataFrame:
    """All bounds come from the table as given, also when rows are dropped."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return apply_bounds(df, fit_bounds(df, columns, method, fold), strategy)


def outlier_report(df: DataFrame, columns: list[str], method: str = "iqr", fold: float = 1.5) -> DataFrame:
    """Bounds, number and share of outliers per column."""
    bounds = fit_bounds(df, columns, method, fold)
    got = aggregate_row(df, {"rows": F.count("*"), **{("n", c): F.count_if(beyond(df, c, b)) for c, b in bounds.items()}})
    rows = []
    for c, (lower, upper) in bounds.items():
        n = got["n", c]
        rows.append((c, None if lower is None else round(lower, 4), None if upper is None else round(upper, 4),
                     n, round(n / got["rows"] * 100, 2) if got["rows"] else 0.0))
    return df.sparkSession.createDataFrame(
        rows, "column string, lower double, upper double, n_outliers bigint, pct double")


def remove_outliers_iqr(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """Drop rows beyond the IQR fences; each column's fences see the rows kept so far."""
    require_numeric(df, columns)
    for c in columns:
        df = apply_bounds(df, fit_bounds(df, [c], "iqr", multiplier), "drop")
    return df
