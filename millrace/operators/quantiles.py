"""Exact quantiles with linear interpolation, for columns of any size.

``percentile`` keeps every distinct value of a column in one task. Here a sketch
first brackets each wanted rank, then one counting pass looks only inside the
brackets, so what reaches the driver is bounded. Brackets that would still hold
too many values are narrowed by further sketches. The result is exact whatever
the sketch said: ranks outside a bracket widen it and repeat.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import aggregate_row, chunks, col, number
from .ordered import running_total

ACCURACY = 10_000
VALUES_PER_BRACKET = 20_000


@dataclass
class Bracket:
    """A wanted rank of a column and the closed interval it lies in."""

    column: str
    prob: float
    rows: int
    low: float
    high: float
    inside: float
    slack: float = 1.0

    @property
    def ranks(self) -> tuple[int, int]:
        at = self.prob * (self.rows - 1)
        return math.floor(at), math.ceil(at)


def _cells(values: DataFrame, fields: dict[str, dict[str, Column]]) -> DataFrame:
    """A row per row and column that has a value: c, the column, and its fields."""
    rows = [F.struct(F.lit(n).alias("c"), *[e.alias(k) for k, e in mine.items()]) for n, mine in fields.items()]
    return values.select(F.inline(F.array(*rows))).filter("x IS NOT NULL")


def quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = ACCURACY,
              values_per_bracket: int = VALUES_PER_BRACKET, found: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles per column; nulls and NaN are left out.

    ``found`` holds, by column, what spares the first sketch: the number of values
    ``present``, ``min``, ``max``, and per quantile a bracket, ``low`` and ``high``,
    with about ``inside`` values.
    """
    out: dict[str, list[float | None]] = {}
    for part in chunks(list(columns), 25):
        out |= _quantiles(df, part, probs, accuracy, values_per_bracket, found or {})
    return out


def _quantiles(df, columns, probs, accuracy, values_per_bracket, found):
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    values = df.select(*[number(df, c).alias(n) for c, n in names.items()])
    margin = 2.0 / accuracy
    edges = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    got = {(n, k): 0 if k == "rows" else None for n in names.values() for k in ("rows", "min", "max", "edges")}
    known = {names[c]: found[c] for c in columns if c in found}
    for n, r in known.items():
        got |= {(n, "rows"): r["present"], (n, "min"): r["min"], (n, "max"): r["max"]}
    sketched = [n for n in names.values() if n not in known]
    cells = _cells(values, {n: {"x": F.col(n)} for n in sketched}) if sketched else None
    for r in [] if cells is None else cells.groupBy("c").agg(F.count("x").alias("rows"), F.min("x").alias("min"), F.max("x").alias("max"),
                                    F.percentile_approx("x", edges, accuracy).alias("edges")).collect():
        got |= {(r["c"], k): r[k] for k in ("rows", "min", "max", "edges")}

    brackets = []
    for n in names.values():
        rows = got[n, "rows"]
        for i, p in enumerate(probs) if rows else []:
            if rows <= values_per_bracket:  # all values may come
                brackets.append(Bracket(n, p, rows, got[n, "min"], got[n, "max"], inside=rows))
            elif n in known:
                brackets.append(Bracket(n, p, rows, max(known[n]["low"][i], got[n, "min"]), min(known[n]["high"][i], got[n, "max"]), known[n]["inside"]))
            else:
                brackets.append(Bracket(n, p, rows, got[n, "edges"][2 * i], got[n, "edges"][2 * i + 1], inside=4.0 * rows / accuracy))
    exact: dict[tuple[str, float], float] = {}
    while brackets:
        wide = [b for b in brackets if b.inside > values_per_bracket and b.low < b.high]
        if wide:
            _narrow(values, wide, accuracy)
            continue
        counts = _count_inside(values, brackets)
        still = []
        for b in brackets:
            result = _read(b, counts[b.column])
            if result is None:
                b.low, b.high = got[b.column, "min"], got[b.column, "max"]
                b.inside, b.slack = b.rows, 2 * b.slack
                still.append(b)
            else:
                exact[b.column, b.prob] = result
        brackets = still
    return {c: [exact.get((n, p)) for p in probs] for c, n in names.items()}


def _narrow(values: DataFrame, brackets: list[Bracket], accuracy: int) -> None:
    """Shrink brackets by a sketch of the values strictly inside them."""
    inner = [F.when((F.col(b.column) > b.low) & (F.col(b.column) < b.high), F.col(b.column)) for b in brackets]
    wanted = {}
    for i, b in enumerate(brackets):
        wanted[i, "below"] = F.count_if(F.col(b.column) < b.low)
        wanted[i, "upto"] = F.count_if(F.col(b.column) <= b.low)
        wanted[i, "in"] = F.count(inner[i])
    got = aggregate_row(values, wanted)

    sketches = {}
    for i, b in enumerate(brackets):
        start, size, (first, last) = got[i, "upto"], got[i, "in"], b.ranks
        b.inside = 0
        if got[i, "below"] > first or last < start:
            b.high = b.low
        elif first >= start + size:
            b.low = b.high
        elif size:
            margin = 2.0 / accuracy * b.slack
            low, high = (first - start) / size - margin, (last + 1 - start) / size + margin
            sketches[i] = F.percentile_approx(inner[i], [max(0.0, low), min(1.0, high)], accuracy)
    for i, (low, high) in aggregate_row(values, sketches).items():
        b = brackets[i]
        if b.ranks[0] >= got[i, "upto"]:
            b.low = low
        if b.ranks[1] < got[i, "upto"] + got[i, "in"]:
            b.high = high
        b.inside = 4.0 * got[i, "in"] / accuracy * b.slack


def _count_inside(values: DataFrame, brackets: list[Bracket]) -> dict[str, list[tuple[int, list]]]:
    """Per column and merged bracket: rows below it, and (value, rows) inside it."""
    merged: dict[str, list[list[float]]] = {}
    for b in sorted(brackets, key=lambda b: (b.column, b.low, b.high)):
        spans = merged.setdefault(b.column, [])
        if spans and b.low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b.high)
        else:
            spans.append([b.low, b.high])

    def zone(name: str) -> Column:
        """0 below the first span, 1 inside it, 2 up to the next, and so on."""
        at, out = F.col(name), F.lit(2 * len(merged[name]))
        for i, (low, high) in reversed(list(enumerate(merged[name]))):
            out = F.when(at < low, 2 * i).when(at <= high, 2 * i + 1).otherwise(out)
        return out

    cells = _cells(values, {n: {"x": F.col(n), "zone": zone(n)} for n in merged})
    counted = cells.groupBy("c", "zone", F.when(F.col("zone") % 2 == 1, F.col("x")).alias("x")).count().collect()
    zones: dict[tuple[str, int], list] = {}
    for r in counted:
        zones.setdefault((r["c"], r["zone"]), []).append((r["x"], r["count"]))
    out = {}
    for n, spans in merged.items():
        size = lambda i: sum(count for _, count in zones.get((n, i), []))
        out[n] = [(sum(size(j) for j in range(2 * i + 1)), sorted(zones.get((n, 2 * i + 1), []))) for i in range(len(spans))]
    return out


def _value_at(rank: int, spans: list[tuple[int, list]]) -> float | None:
    for below, values in spans:
        seen = below
        for x, count in values if rank >= below else []:
            seen += count
            if rank < seen:
                return x
    return None


def _read(b: Bracket, spans: list[tuple[int, list]]) -> float | None:
    """Value at the bracket's rank, or None if it is outside what was counted."""
    low, high = (_value_at(rank, spans) for rank in b.ranks)
    if low is None or high is None:
        return None
    part = b.prob * (b.rows - 1) - b.ranks[0]
    return low if part == 0 or low == high else low + (high - low) * part


def group_quantiles(df: DataFrame, group: str, column: str, probs: list[float],
                    rows_per_bucket: int | None = None) -> DataFrame:
    """Exact quantiles ``q0, q1, …`` of a column per group.

    Equal values are counted first, so a hot group arrives as its distinct
    values; if these are still too many for one task the running count splits
    the group by value range.
    """
    counted = (
        df.select(col(group).alias("g"), number(df, column).alias("x")).filter("x IS NOT NULL")
        .groupBy("g", "x").agg(F.count("*").alias("n"))
    )
    totals = counted.groupBy("g").agg(F.sum("n").alias("rows"))
    upto = running_total(counted, F.col("n"), "upto", ["g"], ["x"], rows_per_bucket)
    ranked = upto.join(totals.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).drop("g2")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("x")))

    aggregates = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("rows") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.first(place - F.floor(place))
        aggregates.append(F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part).alias(f"q{i}"))
    return ranked.groupBy(F.col("g").alias(group)).agg(*aggregates)
