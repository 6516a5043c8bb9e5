"""Column profiles, numeric cards, histograms and before/after comparison."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..frame import PreconditionError, aggregate_row, col, number, require_columns, require_numeric
from ..functions.numbers import plain_number
from ..operators.quantiles import quantiles
from .facts import ColumnFacts, add_text_range, as_text, column_facts, kind_of, read_once

FEW_CATEGORIES = 20
HISTOGRAM_BINS = 10


def logical_type(f: ColumnFacts) -> str:
    """Boolean, Numeric, Date, Categorical or Text."""
    if f.kind in ("boolean", "numeric", "temporal"):
        return {"boolean": "Boolean", "numeric": "Numeric", "temporal": "Date"}[f.kind]
    if f.kind == "text" and f.got.get("dates") and f.share("dates") >= 0.5:
        return "Date"
    return "Categorical" if f.distinct < FEW_CATEGORIES else "Text"


def column_types(df: DataFrame) -> DataFrame:
    """(name, position, detected_type)."""
    facts = column_facts(read_once(df), dates=True, values=1)
    rows = [(f.name, i, logical_type(f)) for i, f in enumerate(facts)]
    return df.sparkSession.createDataFrame(rows, "name string, position int, detected_type string")


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """One row per column: type, nulls, distinct values, range, mean, top values.

    ``top_values`` is a JSON object of the most frequent values; equal counts
    are ordered by value.
    """
    rows, df = [], read_once(df)
    facts = column_facts(df, moments=True, dates=True, values=top)
    add_text_range(df, [f for f in facts if f.kind == "text" and logical_type(f) == "Date"])
    for i, f in enumerate(facts):
        kind, got = logical_type(f), f.got
        shown = kind in ("Numeric", "Date") and got.get("min") is not None
        rows.append((
            f.name, i, kind, f.nulls, f.nulls / f.rows * 100 if f.rows else 0.0, f.distinct,
            str(got["min"]) if shown else None, str(got["max"]) if shown else None,
            got.get("mean") if kind == "Numeric" else None,
            json.dumps(dict(f.top), ensure_ascii=False)))
    return df.sparkSession.createDataFrame(rows, (
        "name string, position int, detected_type string, null_count bigint, null_pct double, "
        "unique_count bigint, min_val string, max_val string, mean_val double, top_values string"))


def top_values(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """(value, n_rows) of the most frequent values as text; empty text is null."""
    require_columns(df, [column])
    texts = df.select(F.nullif(as_text(df, column), F.lit("")).alias("value")).filter("value IS NOT NULL")
    counted = texts.groupBy("value").agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), F.asc("value")).limit(limit)


def numeric_card(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean, median, population std, skewness and excess kurtosis.

    Shape is 0 for constant columns and for fewer than three values.
    """
    require_numeric(df, columns)
    medians = quantiles(df, columns, [0.5])
    rows = []
    for f in column_facts(df, columns, moments=True):
        got = f.got
        shaped = f.present >= 3 and got["std_pop"] > 0
        real = lambda k: None if got[k] is None else float(got[k])
        rows.append((f.name, f.present, real("min"), real("max"), got["mean"], medians[f.name][0], got["std_pop"],
                     got["skew"] if shaped else 0.0, got["kurtosis"] if shaped else 0.0))
    return df.sparkSession.createDataFrame(rows, (
        "column string, n_values bigint, min double, max double, mean double, median double, "
        "std_dev double, skewness double, kurtosis double"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lower, upper, n_rows, n_excluded) of the values inside the IQR fences."""
    require_numeric(df, [column])
    x = number(df, column)
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    values = df.select(x.alias("x")).filter("x IS NOT NULL")
    reach = None if q1 is None else 1.5 * (q3 - q1)
    total = aggregate_row(values, {"n": F.count("*")})["n"]
    clipped = values.filter(F.col("x").between(q1 - reach, q3 + reach)) if total >= 4 and reach else values
    got = aggregate_row(clipped, {"n": F.count("*"), "min": F.min("x"), "max": F.max("x")})
    schema = "bin int, lower double, upper double, n_rows bigint, n_excluded bigint"
    if got["n"] < 2 or got["min"] == got["max"]:
        return df.sparkSession.createDataFrame([], schema)
    low, width = got["min"], (got["max"] - got["min"]) / bins
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counted = clipped.groupBy(at.alias("bin")).agg(F.count("*").alias("n_rows"))
    every = df.sparkSession.createDataFrame(
        [(i, low + i * width, low + (i + 1) * width) for i in range(bins)], "bin int, lower double, upper double")
    return every.join(counted, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.lit(total - got["n"]).cast("bigint").alias("n_excluded"))


def _column_summary(df: DataFrame, column: str) -> DataFrame:
    text = F.nullif(as_text(df, column), F.lit(""))
    x = number(df, column) if kind_of(df, column) == "numeric" else plain_number(text)
    return df.agg(F.count("*").alias("total"), F.count_if(text.isNull()).alias("null_count"),
                  F.count_distinct(text).alias("n_unique"), F.avg(x).alias("mean"))


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Rows, nulls, distinct values and mean before, after, and their difference."""
    require_columns(before, [column])
    require_columns(after, [column])
    b, a = _column_summary(before, column).first(), _column_summary(after, column).first()
    rows = []
    for measure in ("total", "null_count", "n_unique", "mean"):
        x, y = (None if r[measure] is None else float(r[measure]) for r in (b, a))
        rows.append((measure, x, y, None if x is None or y is None else y - x))
    return before.sparkSession.createDataFrame(rows, "measure string, before double, after double, delta double")


def before_after_sample(before: DataFrame, after: DataFrame, column: str, key: list[str], limit: int = 15) -> DataFrame:
    """Values of the first rows by key, before and after (null if the row is gone)."""
    if not key:
        raise PreconditionError("a sample needs the key that identifies a row")
    order = [col(k).asc_nulls_last() for k in key]
    first = before.select(*[col(k) for k in key], col(column).alias("before")).orderBy(*order).limit(limit)
    later = after.select(*[col(k).alias(f"_{k}") for k in key], col(column).alias("after"))
    same = None
    for k in key:
        part = col(k).eqNullSafe(col(f"_{k}"))
        same = part if same is None else same & part
    return first.join(later, same, "left").drop(*[f"_{k}" for k in key])
