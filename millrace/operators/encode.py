"""Encoding a categorical column as numbers.

One-hot and ordinal maps become literals, and the number of categories is
checked first. Frequency, target and binary encoding may see any number of
categories, so their maps stay DataFrames and are joined: Spark broadcasts the
map when it is small, and otherwise splits skewed partitions of the table side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..frame import PreconditionError, col, data_type, require_columns, value
from .ordered import row_number

METHODS = ("one_hot", "ordinal", "frequency", "target", "binary")
LITERAL_CATEGORIES = 100


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(category, n); a null category is refused."""
    require_columns(df, [column])
    return df.groupBy(value(df, column).alias("category")).agg(F.count("*").alias("n"))


def _refuse_nulls(df: DataFrame, column: str) -> int:
    """Number of rows; nulls in the column raise."""
    rows, present = df.agg(F.count("*"), F.count(value(df, column))).first()
    if present < rows:
        raise PreconditionError(f"column {column!r} holds {rows - present} nulls; fill them first")
    return rows


def fit_one_hot(df: DataFrame, column: str, max_categories: int = 50) -> list:
    """Sorted categories, at most ``max_categories`` of them."""
    found = category_counts(df, column).select("category").limit(max_categories + 2).collect()
    categories = [r[0] for r in found]
    if None in categories:
        raise PreconditionError(f"column {column!r} holds nulls; fill them first")
    if len(categories) > max_categories:
        _refuse_nulls(df, column)
        raise PreconditionError(
            f"column {column!r} has more than {max_categories} categories; use binary or frequency encoding")
    return sorted(categories)


def apply_one_hot(df: DataFrame, column: str, categories: list, drop_first: bool = True) -> DataFrame:
    kept = categories[1:] if drop_first else categories
    flags = {f"{column}_{v}": F.coalesce((col(column) == v).cast("int"), F.lit(0)) for v in kept}
    return (df.withColumns(flags) if flags else df).drop(column)


def apply_ordinal(df: DataFrame, column: str, ordered: list) -> DataFrame:
    """Index in the given order, the last one of a repeated value; other values become null."""
    code_of = {v: i for i, v in enumerate(ordered) if v is not None}
    if len(code_of) > LITERAL_CATEGORIES:
        kind = T.StructType([T.StructField("category", data_type(df, column)), T.StructField("code", T.LongType())])
        return _in_place(df, column, df.sparkSession.createDataFrame(list(code_of.items()), kind), "code")
    codes = F.create_map(*[x for v, i in code_of.items() for x in (F.lit(v), F.lit(i).cast("bigint"))])
    return df.withColumn(column, F.try_element_at(codes, col(column)))


def category_codes(df: DataFrame, column: str, rows_per_bucket: int | None = None) -> DataFrame:
    """(category, code) with codes 0, 1, … in sorted order."""
    counts = category_counts(df, column)
    return row_number(counts, "code", [], ["category"], rows_per_bucket).select(
        "category", (F.col("code") - 1).alias("code"))


def join_codes(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Left join of a (category, …) table on the column."""
    return df.join(codes, col(column) == codes["category"], "left").drop("category")


def _in_place(df: DataFrame, column: str, fitted: DataFrame, name: str) -> DataFrame:
    joined = join_codes(df.withColumnRenamed(column, "_source"), "_source", fitted)
    return joined.select(*[F.col(name).alias(c) if c == column else col(c) for c in df.columns])


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    """(category, freq): share of the rows."""
    total = _refuse_nulls(df, column)
    return category_counts(df, column).select("category", (F.col("n") / F.lit(total)).alias("freq"))


def fit_target(df: DataFrame, column: str, target: str, smoothing: float = 1.0,
               min_samples_leaf: int = 20) -> DataFrame:
    """(category, encoded): category mean of the target, drawn to the overall mean.

    The weight of the category mean is 1 / (1 + exp(-(n − min_samples_leaf) /
    smoothing)).
    """
    require_columns(df, [column, target])
    _refuse_nulls(df, column)
    y = value(df, target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    stats = df.groupBy(value(df, column).alias("category")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    steep = (F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-steep))
    blended = weight * F.coalesce("mean", F.lit(prior)) + (F.lit(1.0) - weight) * F.lit(prior)
    return stats.select("category", blended.alias("encoded"))


def encode_categorical(df: DataFrame, column: str, method: str, ordered_categories: list | None = None,
                       target_column: str | None = None, drop_first: bool = True, max_categories: int = 50,
                       smoothing: float = 1.0, min_samples_leaf: int = 20,
                       rows_per_bucket: int | None = None) -> DataFrame:
    """Encode a column; nulls in it are refused.

    ``one_hot`` adds 0/1 columns and ``binary`` the base-2 digits of the 1-based
    code, highest first; ``frequency`` adds ``{column}_freq``; these drop the
    source. ``ordinal`` and ``target`` encode in place.
    """
    require_columns(df, [column])
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "one_hot":
        return apply_one_hot(df, column, fit_one_hot(df, column, max_categories), drop_first)
    if method == "target":
        if target_column is None:
            raise PreconditionError("target encoding needs target_column")
        require_columns(df, [target_column])
        return _in_place(df, column, fit_target(df, column, target_column, smoothing, min_samples_leaf), "encoded")
    if method == "frequency":
        fitted = fit_frequency(df, column).withColumnRenamed("freq", f"{column}_freq")
        return join_codes(df, column, fitted).drop(column)

    _refuse_nulls(df, column)
    if method == "ordinal" and ordered_categories is not None:
        return apply_ordinal(df, column, ordered_categories)
    if method == "ordinal":
        known = category_counts(df, column).select("category").limit(LITERAL_CATEGORIES + 1).collect()
        if len(known) <= LITERAL_CATEGORIES:
            return apply_ordinal(df, column, sorted(r[0] for r in known))
        return _in_place(df, column, category_codes(df, column, rows_per_bucket), "code")
    codes = category_codes(df, column, rows_per_bucket)
    highest = codes.agg(F.count("*")).first()[0]
    digits = max(1, math.ceil(math.log2(highest + 1)))
    coded = join_codes(df, column, codes)
    bits = {f"{column}_{i}": F.shiftright(F.col("code") + 1, digits - 1 - i).bitwiseAND(F.lit(1)).cast("int")
            for i in range(digits)}
    return coded.withColumns(bits).drop(column, "code")


def encoding_report(df: DataFrame, encoded: DataFrame, column: str, method: str) -> DataFrame:
    """One row: method, new columns, and the number of categories before."""
    new = [c for c in encoded.columns if c not in df.columns or (c == column and method in ("ordinal", "target"))]
    n_unique = category_counts(df, column).filter("category IS NOT NULL").count()
    return df.sparkSession.createDataFrame(
        [(method, new, n_unique, len(new))],
        "method string, new_columns array<string>, n_unique bigint, n_new_columns bigint")
