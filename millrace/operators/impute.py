"""Filling missing values with constants and column statistics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F, types as T

from ..frame import (
    PreconditionError, data_type, in_parallel, is_numeric, require_columns, require_numeric, value,
)
from .fits import Ask, Fit, alone


@alone
def fit_fill(df: DataFrame, columns: list[str], method: str, constant=None) -> Fit:
    """Fill value per column."""
    require_columns(df, columns)
    if method == "constant":
        wrong = [c for c in columns if is_numeric(df, c) and isinstance(constant, str)]
        if wrong:
            raise PreconditionError(f"text {constant!r} cannot fill the numeric columns {wrong}")
        return {c: constant for c in columns}
    if method in ("mean", "median"):
        require_numeric(df, columns)
    if method == "mean":
        return (yield Ask({c: F.avg(value(df, c)) for c in columns}))
    if method == "median":
        got = yield Ask(quantiles={c: [0.5] for c in columns})
        return {c: got[c, 0.5] for c in columns}
    if method == "mode":
        found = in_parallel(df.sparkSession, [partial(most_frequent, df, c) for c in columns])
        return dict(zip(columns, found))
    raise ValueError(f"unknown method {method!r}")


def most_frequent(df: DataFrame, column: str):
    """Most frequent value; the smallest on a tie; None if all are null."""
    v = value(df, column).alias("v")
    counted = df.select(v).filter("v IS NOT NULL").groupBy("v").count()
    top = counted.orderBy(F.desc("count"), F.asc("v")).limit(1).collect()
    return top[0]["v"] if top else None


def apply_fill(df: DataFrame, fills: dict) -> DataFrame:
    """Put the fill values where cells are null.

    An integer column filled with a fraction becomes double.
    """
    out = {}
    for c, v in fills.items():
        if v is None:
            continue
        kind = data_type(df, c)
        if isinstance(kind, T.IntegralType) and isinstance(v, float):
            kind = T.DoubleType()
        out[c] = F.coalesce(value(df, c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(out) if out else df


def fill_missing(df: DataFrame, columns: list[str], method: str = "constant", value=None) -> DataFrame:
    """Fill nulls by constant, mean, median or mode."""
    return apply_fill(df, fit_fill(df, columns, method, value))
