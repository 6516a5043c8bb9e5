"""Replay of an ordered list of steps.

A step is ``{"operation": …, "params": {…}}`` with an optional ``step_id`` and
``parameter_checksum``. Each step adds to one lazy plan; only steps that learn
from the data run a job, an aggregate. A step that fails is left out and
reported, and the later steps still run. Since Spark is lazy, failures are found
while the plan is built: in the schema, in a checked precondition, or in a fit.
Conversions use functions that give null, so cells cannot fail later.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..frame import (
    MissingColumnError, PreconditionError, aggregate_row, is_fractional, require_columns, resolve_columns,
    settle, value,
)
from ..operators import binning, columns, combine, dedupe, encode, impute, knn, outliers, resample, scale, windows
from ..operators.columns import convert_type
from ..operators.fits import Fit, together
from ..sources.dates import standardise_dates

ERRORS = "step_index int, operation string, error string, skipped_by string"


class StepListError(ValueError):
    """The list of steps itself is malformed."""


class ChecksumError(ValueError):
    """A step's parameters differ from what its checksum was made of."""


class TypeChangeError(ValueError):
    """A step silently turned a float column into text."""


def _merge(df, tables, secondary_dataset_id, how="inner", left_on=None, right_on=None, **options):
    if secondary_dataset_id not in tables:
        raise PreconditionError(f"table {secondary_dataset_id!r} was not given")
    if not left_on:
        raise PreconditionError("merge needs left_on")
    return combine.merge(df, tables[secondary_dataset_id], left_on, right_on, how, **options)


def _concat(df, tables, secondary_dataset_id, axis=0, order_by=None, other_order_by=None):
    if secondary_dataset_id not in tables:
        raise PreconditionError(f"table {secondary_dataset_id!r} was not given")
    return combine.concat(df, tables[secondary_dataset_id], axis, order_by, other_order_by)


def _imbalance(df, target_column, **options):
    require_columns(df, [target_column])
    if is_fractional(df, target_column):
        v = value(df, target_column)
        got = aggregate_row(df, {"n": F.count(v), "whole": F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True))})
        kinds = df.select(v.alias("v")).filter("v IS NOT NULL").distinct().count() if not got["whole"] else 0
        if kinds > 10 or (got["n"] and kinds / got["n"] > 0.3):
            raise PreconditionError(f"target {target_column!r} looks continuous; bin it first")
    missing = aggregate_row(df, {"n": F.count_if(value(df, target_column).isNull())})["n"]
    if missing:
        raise PreconditionError(f"target {target_column!r} holds {missing} nulls; drop or fill them first")
    return resample.handle_imbalance(df, target_column, **options)


def _lag(df, column, lags, sort_by=None, order_by=None, **options):
    return windows.create_lag_features(df, column, lags, sort_by or order_by, **options)


def _rolling(df, column, sort_by=None, order_by=None, **options):
    return windows.create_rolling_features(df, column, order_by=sort_by or order_by, **options)


def _to_numeric(df, columns):
    return convert_type(df, columns, "numeric")


OPERATIONS = {
    "drop_missing": columns.drop_missing,
    "fill_missing": impute.fill_missing,
    "knn_impute": knn.knn_impute,
    "drop_duplicates": dedupe.drop_duplicates,
    "text_case": columns.text_case,
    "extract_datetime": columns.extract_datetime,
    "time_series_fill": windows.time_series_fill,
    "convert_type": columns.convert_type,
    "round_numeric": columns.round_numeric,
    "validate_format": columns.validate_format,
    "extract_numeric": columns.extract_numeric,
    "remove_outliers_iqr": outliers.remove_outliers_iqr,
    "standard_scale": scale.standard_scale,
    "normalize": scale.normalize,
    "rename_columns": columns.rename_columns,
    "drop_columns": columns.drop_columns,
    "filter_rows": columns.filter_rows,
    "merge": _merge,
    "concat": _concat,
    "add_missingness_indicator": columns.add_missingness_indicator,
    "encode_categorical": encode.encode_categorical,
    "handle_outliers": outliers.handle_outliers,
    "handle_imbalance": _imbalance,
    "bin_column": binning.bin_column,
    "extract_datetime_components": columns.extract_datetime_components,
    "create_lag_features": _lag,
    "create_rolling_features": _rolling,
    "trim_whitespace": columns.trim_whitespace,
    "replace_with_null": columns.replace_with_null,
    "standardise_dates": standardise_dates,
    "robust_scale": scale.robust_scale,
    "drop_missing_specific": columns.drop_missing,
    "convert_type_numeric": _to_numeric,
}
FITTED = {
    "fill_missing", "knn_impute", "remove_outliers_iqr", "standard_scale", "normalize", "encode_categorical",
    "handle_outliers", "handle_imbalance", "bin_column", "time_series_fill", "create_lag_features",
    "create_rolling_features", "standardise_dates", "robust_scale",
}
#: Steps whose result is costly to make again.
COSTLY = {
    "merge", "concat", "drop_duplicates", "knn_impute", "handle_imbalance", "time_series_fill", "create_lag_features",
    "create_rolling_features",
}
CHANGES_TYPES = {
    "convert_type", "extract_numeric", "bin_column", "encode_categorical", "extract_datetime_components",
    "convert_type_numeric",
}


@dataclass
class Learnt:
    """A step that learns by aggregates: its fit, what it does with the result, and the columns it reads and writes."""

    fit: Callable[[DataFrame], Fit]
    apply: Callable[[DataFrame, object], DataFrame]
    reads: list[str]
    writes: list[str]
    keeps_rows: bool = True


def _learn_fill(columns, method="constant", value=None):
    if method != "mode":  # which takes a count of all values
        return Learnt(lambda df: impute.fit_fill.fit(df, columns, method, value), impute.apply_fill, columns, columns)


def _learn_standard(columns):
    return Learnt(lambda df: scale.fit_standard.fit(df, columns), scale.apply_center, columns, columns)


def _learn_robust(columns):
    return Learnt(lambda df: scale.fit_robust.fit(df, columns), scale.apply_center, columns, columns)


def _learn_normalize(columns, **span):
    return Learnt(lambda df: scale.fit_min_max.fit(df, columns), lambda df, got: scale.apply_min_max(df, got, **span), columns, columns)


def _learn_outliers(columns, method="iqr", fold=1.5, strategy="cap"):
    if strategy in outliers.STRATEGIES:
        writes = [f"{c}_is_outlier" for c in columns] if strategy == "flag" else columns
        return Learnt(lambda df: outliers.fit_bounds.fit(df, columns, method, fold),
                      lambda df, got: outliers.apply_bounds(df, got, strategy), columns, writes, strategy != "drop")


def _learn_bins(column, strategy="equal_width", n_bins=5, labels=None, custom_boundaries=None, output_column=None, drop_original=False):
    writes = [output_column or f"{column}_binned", *[column] * drop_original]
    return Learnt(lambda df: binning.fit_bins.fit(df, column, strategy, n_bins, labels, custom_boundaries),
                  lambda df, got: binning.apply_bins(df, column, got, output_column, drop_original), [column], writes)


#: Steps whose fits can be answered together with those of their neighbours.
LEARNT = {
    "fill_missing": _learn_fill, "standard_scale": _learn_standard, "robust_scale": _learn_robust,
    "normalize": _learn_normalize, "handle_outliers": _learn_outliers, "bin_column": _learn_bins,
}
#: Steps on the cells of the columns they name; rows and other columns stay.
CELLWISE = {
    "text_case", "round_numeric", "extract_numeric", "trim_whitespace", "replace_with_null", "convert_type", "convert_type_numeric",
}


def step_checksum(params: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def _prepared(df: DataFrame, step: dict, tables=None, order_by=None):
    """The operation of a step, its name and parameters, once these are checked."""
    name, params = step["operation"], dict(step.get("params") or {})
    expected = step.get("parameter_checksum")
    if expected and expected != step_checksum(params):
        raise ChecksumError(f"parameters of step {step.get('step_id')} do not fit their checksum")
    if name not in OPERATIONS:
        raise PreconditionError(f"unknown operation {name!r}")
    operation = OPERATIONS[name]
    if params.get("columns"):
        params["columns"] = resolve_columns(df, params["columns"])
    accepted = inspect.signature(operation).parameters
    if "tables" in accepted:
        params["tables"] = tables or {}
    if order_by and "order_by" in accepted and not params.get("order_by"):
        params["order_by"] = order_by
    return operation, name, params


def run_step(df: DataFrame, step: dict, tables: dict[str, DataFrame] | None = None,
             order_by: list[str] | None = None, learnt: tuple[Learnt, object] | None = None) -> DataFrame:
    """Apply one step; ``order_by`` is the row order for steps that name none.

    ``learnt`` is the step's fit with its result, if that is known already.
    """
    operation, name, params = _prepared(df, step, tables, order_by)
    out = learnt[0].apply(df, learnt[1]) if learnt else operation(df, **params)
    if name not in CHANGES_TYPES:
        changed = columns.float_became_text(df, out)
        if changed:
            raise TypeChangeError(f"columns {changed} would turn from float into text")
    return out


def _learnt(df: DataFrame, step: dict) -> Learnt | None:
    """The fit of a step as the table is now, if it is one that can be shared."""
    if step["operation"] not in LEARNT:
        return None
    try:
        operation, name, params = _prepared(df, step)
        inspect.signature(operation).bind(df, **params)
        return LEARNT[name](**params)
    except Exception:  # reported when its turn comes
        return None


def learn_ahead(df: DataFrame, steps: list[dict], first: int) -> dict[int, tuple[Learnt, object]]:
    """Fits of the first step and of later ones that give the same on the table as it is now, answered together.

    A later fit does so while the steps before it keep all rows and write no column
    that it reads. Steps that are not known to do both end the search.
    """
    found: dict[int, Learnt] = {}
    written: set[str] = set()
    for i in range(first, len(steps)):
        step = steps[i]
        one = _learnt(df, step)
        if one is None and step["operation"] in CELLWISE:
            written |= {str(c).lower() for c in (step.get("params") or {}).get("columns") or df.columns}
            continue
        if one is None:
            break
        if not written & {c.lower() for c in one.reads}:
            found[i] = one
        written |= {c.lower() for c in one.writes}
        if not one.keeps_rows:
            break
    if len(found) < 2:
        return {}
    results = together(df, [one.fit(df) for one in found.values()])
    return {i: (one, got) for (i, one), got in zip(found.items(), results) if not isinstance(got, Exception)}  # these are tried again in their turn


def run_steps(df: DataFrame, steps: list[dict], tables: dict[str, DataFrame] | None = None,
              order_by: list[str] | None = None, settle_before_fits: bool | None = None) -> tuple[DataFrame, list[dict]]:
    """Apply steps in order; returns the table and the steps that were left out.

    The same list runs on any table. Fitted steps read their input once more; those
    that do not depend on one another are fitted together, in one pass.
    After a costly step, such as a join, a window or a neighbour search, the table
    is therefore written to the checkpoint folder before the next fit;
    ``settle_before_fits`` asks for this before every fit, or before none.
    """
    ids = [s["step_id"] for s in steps if s.get("step_id")]
    if len(ids) != len(set(ids)):
        raise StepListError("step ids repeat")
    if any("operation" not in s for s in steps):
        raise StepListError("a step lacks its operation")
    errors, changed, costly, ahead = [], False, False, {}
    for i, step in enumerate(steps):
        wanted = costly if settle_before_fits is None else settle_before_fits and changed
        if wanted and step["operation"] in FITTED and i not in ahead:
            df, changed, costly = settle(df), False, False
        if i not in ahead:
            ahead |= learn_ahead(df, steps, i) if step["operation"] in LEARNT else {}
        try:
            df, changed = run_step(df, step, tables, order_by, ahead.get(i)), True
            costly = costly or step["operation"] in COSTLY
        except Exception as error:  # a failing step is reported, the others go on
            unmet = isinstance(error, (PreconditionError, MissingColumnError))
            errors.append({"step_index": i, "operation": step["operation"], "error": str(error).splitlines()[0],
                           "skipped_by": "pre_flight_check" if unmet else "runtime_error"})
    return df, errors


def error_report(spark: SparkSession, errors: list[dict]) -> DataFrame:
    rows = [tuple(e[k] for k in ("step_index", "operation", "error", "skipped_by")) for e in errors]
    return spark.createDataFrame(rows, ERRORS)
