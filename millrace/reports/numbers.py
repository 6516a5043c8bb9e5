"""Facts about the numbers of a large table, from one pass in which each task sorts blocks of rows.

Of every block and column come moments, counts, the values while they are few, and every
so-many-th value. Spark brings the blocks of a column together, where they add up to the
moments of the column, to its values if these are few, and to brackets around its quartiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..fixed_values import NUMERIC_SENTINELS
from ..frame import chunks, data_type, is_integral, ship_code, value

#: Values of a column that are kept while there are no more, and bytes of rows in a block.
FEW_VALUES, BYTES_AT_ONCE = 10, 32 << 20
#: Values of a block that place its quartiles, and columns that share a plan.
POINTS, COLUMNS_AT_ONCE = 4096, 100
#: Whole numbers below this are exact as doubles.
EXACT_IN_DOUBLE = 2**53
#: Counts of values between two numbers, by name.
RANGES = {"salary": (10_000, 10_000_000), "vital": (60, 200), "lab": (50, 500), "percent": (0, 100), "small": (1, 100)}
ADDED = ["rows", "present", "negatives", "positive", "sentinels", "binary", *RANGES, "at_most"]
MOMENTS = ["sum", "mean", "m2", "m3", "m4"]
BLOCK = "c int, " + ", ".join([f"{n} bigint" for n in ADDED] + [f"{n} double" for n in MOMENTS]) + \
    ", again boolean, many boolean, min double, max double, least_whole bigint, most_whole bigint, d array<double>, l array<bigint>, k array<bigint>"


def _bound(x) -> int:
    return max(-2**63, min(2**63 - 1, int(x)))


def _of_block(x: np.ndarray, rows: int, whole: bool, rng: np.random.Generator) -> dict:
    """Facts about the values ``x`` of a column, maybe one of whole numbers, in a block of so many rows.

    Points start anywhere in the first step, so that blocks that are alike do not err alike.
    """
    if not len(x):
        return {"rows": rows} | dict.fromkeys(ADDED[1:], 0) | {"again": False, "many": False, "d": [], "l": [], "k": [], "points": [], "step": 0.0}
    x = np.sort(x) + 0  # which leaves zeros without sign
    starts = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    counts, own = np.diff(starts, append=len(x)), x[starts]
    upto = lambda v, side: int(np.searchsorted(x, v, side))
    held = lambda wanted: int(counts[np.isin(own, wanted)].sum())
    v = own.astype(float)
    # Measured from the first value, so that a constant column has moments of exactly zero.
    shift = ((v - v[0]) * counts).sum() / len(x)
    e = v - v[0] - shift
    squares = e * e * counts
    few = len(own) <= FEW_VALUES
    step = max(1, len(x) // POINTS)
    return {
        "rows": rows, "present": len(x), "negatives": upto(0, "left"), "positive": len(x) - upto(0, "right"), "sentinels": held(NUMERIC_SENTINELS),
        "binary": held([0, 1]) if whole else 0, **{n: upto(b, "right") - upto(a, "left") for n, (a, b) in RANGES.items()}, "at_most": int(counts.max()),
        "sum": float((v * counts).sum()), "mean": float(v[0] + shift), "m2": float(squares.sum()), "m3": float((squares * e).sum()),
        "m4": float((squares * e * e).sum()), "again": len(own) < len(x), "many": not few, "min": float(x[0]), "max": float(x[-1]),
        "least_whole": _bound(x[0]) if whole else None, "most_whole": _bound(x[-1]) if whole else None,
        "d": own.tolist() if few and not whole else [], "l": own.astype(np.int64).tolist() if few and whole else [], "k": counts.tolist() if few else [],
        "points": x[rng.integers(step) :: step].astype(float), "step": float(step),
    }


def blocks(batches: Iterator[pa.RecordBatch], numbers: dict[int, bool], schema: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    """A row of facts per block of rows and column; ``numbers`` are those of the columns and whether they are whole."""
    def facts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        with np.errstate(all="ignore"):
            return pa.RecordBatch.from_pylist([
                {"c": i, **_of_block(table.column(at).drop_null().to_numpy(), len(table), whole, rng)} for at, (i, whole) in enumerate(numbers.items())], schema)

    rng = np.random.default_rng(TaskContext.get().partitionId())
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= at_once:
            yield facts(held)
            held, size = [], 0
    if held:
        yield facts(held)


def _joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and second to fourth central sums of two sets of values together."""
    (n, mean, a2, a3, a4), (m, other, b2, b3, b4) = a, b
    if not n or not m:
        return a if n else b
    t, d = n + m, other - mean
    return (t, mean + d * m / t, a2 + b2 + d * d * n * m / t,
            a3 + b3 + d**3 * n * m * (n - m) / t**2 + 3 * d * (n * b2 - m * a2) / t,
            a4 + b4 + d**4 * n * m * (n * n - n * m + m * m) / t**3 + 6 * d * d * (n * n * b2 + m * m * a2) / t**2 + 4 * d * (n * b3 - m * a3) / t)


def _brackets(points: np.ndarray, weights: np.ndarray, rows: int, slack: float, probs: list[float]) -> tuple[list[float], list[float]]:
    """Points below and above the wanted ranks, further away than the points of all blocks usually err together."""
    order = np.argsort(points, kind="stable")
    points, upto = points[order], np.cumsum(weights[order])
    low = [np.searchsorted(upto, p * (rows - 1) - slack) - 1 for p in probs]
    high = [np.searchsorted(upto, p * (rows - 1) + 1 + slack) + 1 for p in probs]
    return ([float(points[i]) if i >= 0 else -np.inf for i in low], [float(points[i]) if i < len(points) else np.inf for i in high])


def add_up(table: pa.Table, probs: list[float], schema: pa.Schema) -> pa.Table:
    """One row for all blocks of a column."""
    got = {n: table.column(n).to_pylist() for n in table.column_names if n != "points"}
    out = {"c": got["c"][0], **{n: sum(got[n]) for n in ADDED}, "again": any(got["again"])}
    there = [at for at, n in enumerate(got["present"]) if n]
    if there:
        with np.errstate(all="ignore"):
            total = (0, 0.0, 0.0, 0.0, 0.0)
            for at in there:
                total = _joined(total, tuple(np.float64(got[n][at]) for n in ("present", "mean", "m2", "m3", "m4")))
        out |= dict(zip(MOMENTS, (float(sum(got["sum"][at] for at in there)), *map(float, total[1:]))))
        for n, pick in (("min", min), ("max", max), ("least_whole", min), ("most_whole", max)):
            out[n] = pick((got[n][at] for at in there if got[n][at] is not None), default=None)
        points = [table.column("points")[at].values.to_numpy() for at in there]
        steps = np.array([got["step"][at] for at in there])
        weights = np.repeat(steps, [len(p) for p in points])
        slack = 3 * float(np.sqrt((steps**2).sum()))
        out["low"], out["high"] = _brackets(np.concatenate(points), weights, out["present"], slack, probs)
        out["inside"] = 2 * slack + 2
    values: dict = {}
    for d, l, k in zip(got["d"], got["l"], got["k"]):
        for v, n in zip(d or l, k):
            values[v] = values.get(v, 0) + n
    many = any(got["many"]) or len(values) > FEW_VALUES
    whole = out.get("least_whole") is not None
    kept = [] if many else list(values)
    out |= {"many": many, "d": [] if whole else kept, "l": kept if whole else [], "k": [values[v] for v in kept]}
    return pa.Table.from_pylist([out], schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
             "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, types[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def number_facts(df: DataFrame, columns: dict[int, str], probs: list[float], sent_as: str = "double") -> dict[int, dict]:
    """Facts per number of the column, with brackets around the quantiles of ``probs``.

    Values go to Python as doubles, which costs a third of mixed types; whole numbers
    that doubles cannot hold are asked again as they are.
    """
    ship_code(df.sparkSession)
    ddl, total = BLOCK + ", points array<double>, step double", BLOCK + ", low array<double>, high array<double>, inside double"
    out = {}
    for some in chunks(list(columns.items()), COLUMNS_AT_ONCE):
        cells = df.select(*[value(df, c).cast(sent_as).alias(f"x{i}") for i, c in some])
        found = cells.mapInArrow(partial(blocks, numbers={i: is_integral(df, c) for i, c in some}, schema=_arrow(ddl), at_once=BYTES_AT_ONCE), ddl)
        added = found.groupBy("c").applyInArrow(lambda blocks_of_column: add_up(blocks_of_column, probs, _arrow(total)), total)
        narrow = F.col("c").isin([i for i, c in some if isinstance(data_type(df, c), T.FloatType)])
        texts = F.when(narrow, F.transform("d", lambda v: v.cast("float").cast("string"))).otherwise(F.transform("d", lambda v: v.cast("string")))
        shown = F.concat(texts, F.transform("l", lambda v: v.cast("string")))
        out |= {r["c"]: r.asDict() for r in added.withColumn("values", shown).collect()}
    wide = {i: c for i, c in columns.items() if sent_as == "double" and is_integral(df, c) and i in out
            and max(abs(out[i]["min"] or 0), abs(out[i]["max"] or 0)) >= EXACT_IN_DOUBLE}
    return out | (number_facts(df, wide, probs, "bigint") if wide else {})
