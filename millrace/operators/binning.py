"""Cutting a numeric column into labelled bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import PreconditionError, col, number, require_numeric
from .fits import Ask, Fit, alone

STRATEGIES = ("equal_width", "equal_frequency", "custom")
MANY_BINS = 64


@dataclass(frozen=True)
class Bins:
    """Right-closed bins: ``edges`` has one more entry than ``labels``.

    A value equal to the lowest edge belongs to the first bin.
    """

    edges: tuple[float, ...]
    labels: tuple[str, ...]


@alone
def fit_bins(df: DataFrame, column: str, strategy: str = "equal_width", n_bins: int = 5,
             labels: list[str] | None = None, custom_boundaries: list[float] | None = None) -> Fit:
    require_numeric(df, [column])
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "custom":
        edges = [float(b) for b in custom_boundaries or []]
        if len(edges) < 2:
            raise PreconditionError("custom bins need at least two boundaries")
        if any(b <= a for a, b in zip(edges, edges[1:])):
            raise PreconditionError("boundaries must increase")
    elif strategy == "equal_width":
        got = yield Ask({"min": F.min(number(df, column)), "max": F.max(number(df, column))})
        low, high = got["min"], got["max"]
        if low is None:
            raise PreconditionError(f"column {column!r} holds no values")
        if low == high:
            low, high = low - 0.001 * abs(low or 1.0), high + 0.001 * abs(high or 1.0)
            edges = _even(low, high, n_bins)
        else:
            edges = _even(low, high, n_bins)
            edges[0] = low - (high - low) * 0.001
    else:
        probs = [i / n_bins for i in range(n_bins + 1)]
        got = yield Ask(quantiles={column: probs})
        points = [got[column, p] for p in probs]
        if points[0] is None:
            raise PreconditionError(f"column {column!r} holds no values")
        edges = sorted(set(points))
        if len(edges) < 2:
            raise PreconditionError(f"column {column!r} has one value only, so it cannot be cut")
    count = len(edges) - 1
    if labels and len(labels) != count:
        raise PreconditionError(f"{len(labels)} labels for {count} bins")
    shown = _shown(edges)
    names = labels or [f"{column}_{round(a)}_{round(b)}" for a, b in zip(shown, shown[1:])]
    return Bins(tuple(edges), tuple(str(n) for n in names))


def _even(low: float, high: float, n_bins: int) -> list[float]:
    step = (high - low) / n_bins
    return [low + i * step for i in range(n_bins)] + [high]


def _shown(edges: list[float]) -> list[float]:
    """Edges as labels show them: three decimals or as many as tell them apart."""
    digits = next((d for d in range(3, 20) if len({round(e, d) for e in edges}) == len(edges)), 3)
    rounded = [round(e, digits) for e in edges]
    return [rounded[0] - 10.0**-digits, *rounded[1:]]


def bin_index(x: Column, bins: Bins) -> Column:
    """0-based bin of a value; null outside the bins."""
    uppers = bins.edges[1:]
    if len(uppers) > MANY_BINS:
        below = F.size(F.filter(F.array(*[F.lit(e) for e in uppers]), lambda e: e < x))
        return F.when((x >= bins.edges[0]) & (x <= uppers[-1]), below)
    index = F.when(x < bins.edges[0], F.lit(None).cast("int"))
    for i, upper in enumerate(uppers):
        index = index.when(x <= upper, F.lit(i))
    return index


def apply_bins(df: DataFrame, column: str, bins: Bins, output_column: str | None = None,
               drop_original: bool = False) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in bins.labels])
    out = df.withColumn(output_column or f"{column}_binned", F.get(labels, bin_index(number(df, column), bins)))
    return out.drop(column) if drop_original else out


def bin_column(df: DataFrame, column: str, strategy: str = "equal_width", n_bins: int = 5,
               labels: list[str] | None = None, custom_boundaries: list[float] | None = None,
               output_column: str | None = None, drop_original: bool = False) -> DataFrame:
    bins = fit_bins(df, column, strategy, n_bins, labels, custom_boundaries)
    return apply_bins(df, column, bins, output_column, drop_original)


def bin_report(binned: DataFrame, output_column: str) -> DataFrame:
    """Rows per bin label."""
    return binned.groupBy(col(output_column).alias("bin")).agg(F.count("*").alias("n_rows"))
