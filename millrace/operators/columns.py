"""Projection, filtering, conversion and validation of columns.

All of these are lazy per-row expressions: no shuffle, no job, and filters and
column choices reach the scan.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from ..fixed_values import FORMAT_PATTERNS
from ..frame import (
    PreconditionError, aggregate_row, col, is_fractional, is_numeric, is_temporal, is_text, number,
    require_columns, require_numeric, value,
)
from ..functions import dates, numbers, text

log = logging.getLogger(__name__)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Keep rows that satisfy a SQL predicate.

    A comparison with null is not true, so ``a != 1`` drops null rows; write
    ``NOT (a <=> 1)`` to keep them. A predicate that the table cannot answer is
    refused before anything runs.
    """
    try:
        return df.filter(F.expr(condition))
    except AnalysisException as error:
        raise PreconditionError(f"condition {condition!r} is invalid: {str(error).splitlines()[0]}") from error


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any of the columns."""
    require_columns(df, columns)
    for c in columns or df.columns:
        df = df.filter(value(df, c).isNotNull())
    return df


def add_missingness_indicator(df: DataFrame, columns: list[str], drop_original: bool = False) -> DataFrame:
    """Add ``{c}_was_missing`` as 0 or 1."""
    require_columns(df, columns)
    flagged = df.withColumns({f"{c}_was_missing": value(df, c).isNull().cast("int") for c in columns})
    return flagged.drop(*columns) if drop_original else flagged


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows missing per column, as (column, n_missing)."""
    require_columns(df, columns)
    counts = aggregate_row(df, {c: F.count_if(value(df, c).isNull()) for c in columns})
    return df.sparkSession.createDataFrame(list(counts.items()), "column string, n_missing bigint")


def text_case(df: DataFrame, columns: list[str], case: str = "lower") -> DataFrame:
    require_columns(df, columns)
    return df.withColumns({c: text.change_case(col(c), case) for c in columns if is_text(df, c)})


def trim_whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns(
        {c: F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "") for c in columns if is_text(df, c)}
    )


def replace_with_null(df: DataFrame, columns: list[str], values: list) -> DataFrame:
    """Null out placeholder values."""
    require_columns(df, columns)
    return df.withColumns({c: F.when(~col(c).isin(values), col(c)) for c in columns})


def round_numeric(df: DataFrame, columns: list[str], decimals: int = 2) -> DataFrame:
    """Round half to even."""
    require_numeric(df, columns)
    return df.withColumns({c: F.bround(col(c), int(decimals)) for c in columns})


def convert_type(df: DataFrame, columns: list[str], type: str, formats: list[str] | None = None,
                 keep_unparsed: bool = False) -> DataFrame:
    """Convert columns; what cannot be read becomes null.

    ``type`` is numeric, date, string, boolean, numeric_to_text or
    text_to_numeric. ``keep_unparsed`` adds ``{c}_unparsed`` with the text that
    text_to_numeric could not read.
    """
    require_columns(df, columns)
    out = {}
    for c in columns:
        as_text, number_like = col(c).cast("string"), is_numeric(df, c)
        if type == "numeric":
            out[c] = value(df, c) if number_like else (
                numbers.parse_number(col(c)) if is_text(df, c) else col(c).cast("double"))
        elif type == "date":
            out[c] = col(c).cast("timestamp_ntz") if is_temporal(df, c) else dates.parse_timestamp(as_text, formats)
        elif type == "string":
            out[c] = as_text
        elif type == "boolean":
            out[c] = col(c).cast("boolean") if number_like else numbers.to_boolean(as_text)
        elif type == "numeric_to_text":
            out[c] = numbers.number_to_words(col(c)) if number_like else numbers.text_to_words(as_text)
        elif type == "text_to_numeric":
            out[c] = value(df, c) if number_like else numbers.text_to_number(as_text)
            if keep_unparsed and not number_like:
                out[f"{c}_unparsed"] = F.when(numbers.text_to_number(as_text).isNull(), as_text)
        else:
            raise ValueError(f"unknown type {type!r}")
    return df.withColumns(out)


def extract_numeric(df: DataFrame, columns: list[str], on_invalid: str = "null") -> DataFrame:
    """Take the number out of messy text; ``on_invalid`` is null or drop."""
    require_columns(df, columns)
    if on_invalid not in ("null", "drop"):
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    read = lambda c: number(df, c) if is_numeric(df, c) else numbers.extract_number(col(c).cast("string"))
    out = df.withColumns({c: read(c) for c in columns})
    for c in columns if on_invalid == "drop" else []:
        out = out.filter(col(c).isNotNull())
    return out


def validate_format(df: DataFrame, columns: list[str], format_type: str = "email",
                    action: str = "drop_invalid", pattern: str | None = None) -> DataFrame:
    """Drop rows, or null cells, whose text form does not have the format."""
    require_columns(df, columns)
    if action not in ("drop_invalid", "set_null"):
        raise ValueError(f"unknown action {action!r}")
    if format_type not in FORMAT_PATTERNS and format_type != "custom":
        log.warning("format %r is not known; its pattern is used", format_type)
    valid = {c: text.matches_format(col(c), format_type, pattern) for c in columns}
    if action == "set_null":
        return df.withColumns({c: F.when(ok, col(c)) for c, ok in valid.items()})
    for ok in valid.values():
        df = df.filter(ok)
    return df


def _moment(df: DataFrame, column: str):
    if is_temporal(df, column):
        return col(column)
    if is_text(df, column):
        return dates.parse_timestamp(col(column))
    raise PreconditionError(f"column {column!r} holds neither dates nor text; convert it to a date first")


def extract_datetime(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add year, month and day of several columns."""
    require_columns(df, columns)
    parts = ("year", "month", "day")
    return df.withColumns(
        {f"{c}_{p}": dates.COMPONENTS[p](_moment(df, c)) for c in columns for p in parts}
    )


def extract_datetime_components(df: DataFrame, column: str, components: list[str]) -> DataFrame:
    """Add ``{column}_{component}``; weekdays count from Monday = 0."""
    unknown = [c for c in components if c not in dates.COMPONENTS]
    if unknown:
        raise ValueError(f"unknown components {unknown}")
    require_columns(df, [column])
    dated = df.withColumn(column, _moment(df, column))
    return dated.withColumns({f"{column}_{p}": dates.COMPONENTS[p](col(column)) for p in components})


def float_became_text(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns that silently turned from float to text."""
    return [c for c in before.columns if c in after.columns and is_fractional(before, c)
            and isinstance(after.schema[c].dataType, T.StringType)]
