"""Scaling numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frame import PreconditionError, number, require_numeric
from .fits import Ask, Fit, alone


@alone
def fit_standard(df: DataFrame, columns: list[str]) -> Fit:
    """(mean, population std) per column; nulls are refused by the same aggregate."""
    require_numeric(df, columns)
    wanted = {}
    for c in columns:
        v = number(df, c)
        wanted[c, "mean"], wanted[c, "std"] = F.avg(v), F.stddev_pop(v)
        wanted[c, "nulls"] = F.count_if(v.isNull())
    got = yield Ask(wanted)
    nulls = {c: got[c, "nulls"] for c in columns if got[c, "nulls"]}
    if nulls:
        raise PreconditionError(f"columns hold nulls: {nulls}; fill or drop them first")
    return {c: (got[c, "mean"], got[c, "std"]) for c in columns}


@alone
def fit_min_max(df: DataFrame, columns: list[str]) -> Fit:
    require_numeric(df, columns)
    got = yield Ask({(c, s): f(number(df, c)) for c in columns for s, f in (("min", F.min), ("max", F.max))})
    return {c: (got[c, "min"], got[c, "max"]) for c in columns}


@alone
def fit_robust(df: DataFrame, columns: list[str]) -> Fit:
    """(median, interquartile range) per column."""
    require_numeric(df, columns)
    got = yield Ask(quantiles={c: [0.25, 0.5, 0.75] for c in columns})
    return {c: (got[c, 0.5], None if got[c, 0.25] is None else got[c, 0.75] - got[c, 0.25]) for c in columns}


def apply_center(df: DataFrame, fitted: dict) -> DataFrame:
    """(value − center) / width; a column of width 0 becomes 0."""
    out = {}
    for c, (center, width) in fitted.items():
        if center is not None:
            out[c] = (number(df, c) - F.lit(center)) / F.lit(float(width or 1.0))
    return df.withColumns(out) if out else df


def apply_min_max(df: DataFrame, fitted: dict, feature_min: float = 0.0, feature_max: float = 1.0) -> DataFrame:
    """Stretch to the target range; a constant column becomes ``feature_min``, nulls stay."""
    low, span = float(feature_min), float(feature_max) - float(feature_min)
    out = {}
    for c, (smallest, largest) in fitted.items():
        v = number(df, c)
        if smallest is not None and largest > smallest:
            out[c] = (v - F.lit(smallest)) / F.lit(largest - smallest) * span + low
        else:
            out[c] = F.when(v.isNotNull(), F.lit(low))
    return df.withColumns(out)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_center(df, fit_standard(df, columns))


def normalize(df: DataFrame, columns: list[str], feature_min: float = 0.0, feature_max: float = 1.0) -> DataFrame:
    return apply_min_max(df, fit_min_max(df, columns), feature_min, feature_max)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_center(df, fit_robust(df, columns))
