"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..frame import col, has_map, orderable, require_columns


def drop_duplicates(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Keep one row per key, or one of each fully equal row.

    With key columns the first row by ``order_by`` stays, ties broken by the rest of
    the row. Every task keeps only its own first row of a key before the shuffle, so
    copies of a hot key never meet in one sort, and a row travels once.
    """
    require_columns(df, columns)
    require_columns(df, order_by)
    if not columns and not any(has_map(f.dataType) for f in df.schema.fields):
        return df.distinct()
    order = [f for c in order_by or [] for f in (col(c).isNull(), orderable(df, c))]
    order += [orderable(df, c) for c in df.columns if c not in (order_by or [])]
    place = "_place"
    while place in df.columns:
        place += "_"
    first = F.row_number().over(Window.partitionBy(*[orderable(df, c) for c in columns or df.columns]).orderBy(*order))
    return df.withColumn(place, first).filter(F.col(place) == 1).drop(place)


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of each fully equal row."""
    keys = [orderable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def duplicate_report(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and duplicate rows."""
    keys = [orderable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    )
