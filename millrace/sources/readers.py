"""Readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..fixed_values import CSV_NULL_TOKENS
from ..frame import aggregate_row, chunks, col
from ..functions.numbers import plain_number
from .dates import standardise_dates
from .flatten import flatten


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8",
             multi_line: bool = False, dates: bool = True) -> DataFrame:
    """CSV with a header; the usual spellings of a missing value become null.

    Without a schema, types come from one aggregate over all cells, after the
    missing values are known, so ``NA`` does not turn a number column into text.
    ``multi_line`` allows line breaks inside quotes, at the price of reading each
    file in one task.
    """
    reader = spark.read.options(header=True, encoding=encoding, escape='"', multiLine=multi_line)
    raw = reader.csv(path)
    if schema is not None:
        raw = raw.toDF(*schema.names)
    clean = raw.select(*[F.when(~col(c).isin(CSV_NULL_TOKENS), col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        return clean.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    typed = infer_types(clean)
    return standardise_dates(typed) if dates else typed


def _as_boolean(c: Column) -> Column:
    return F.when(c.isin("True", "TRUE", "true"), True).when(c.isin("False", "FALSE", "false"), False)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as bigint, double or boolean where every value reads so."""
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
    kinds = {"long": whole, "double": plain_number, "boolean": _as_boolean}
    out = {}
    for part in chunks(df.columns, 50):
        fits = {(c, k): F.bool_and(read(col(c)).isNotNull() | col(c).isNull()) for c in part for k, read in kinds.items()}
        got = aggregate_row(df, {**fits, **{(c, "n"): F.count(col(c)) for c in part}}, 4 * len(part))
        for c in part:
            kind = next((k for k in kinds if got[c, "n"] and got[c, k]), None)
            out[c] = kinds[kind](col(c)) if kind else col(c)
    return df.select(*[e.alias(c) for c, e in out.items()])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8",
              lines: bool = False, dates: bool = True, sep: str = ".") -> DataFrame:
    """JSON records, flattened.

    By default a file is one document (a list of records, or one record). Large
    data should come as one record per line (``lines=True``), which splits.
    """
    reader = spark.read.options(multiLine=not lines, encoding=encoding)
    flat = flatten((reader.schema(schema) if schema else reader).json(path), sep)
    return standardise_dates(flat) if dates else flat


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, file_format: str, **options) -> DataFrame:
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    if file_format not in readers:
        raise ValueError(f"unsupported file format {file_format!r}")
    return readers[file_format](spark, path, **options)


def preview(df: DataFrame, order_by: list[str], limit: int = 100) -> DataFrame:
    """First rows in the given order."""
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(limit)
