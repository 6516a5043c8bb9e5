"""Row-wise steps on a streaming DataFrame.

Steps that look at one row at a time run on a stream unchanged. Steps that learn
from the data are fitted on a batch, and their ``apply_…`` half is a projection
that a stream can carry too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..frame import PreconditionError
from ..plans.steps import run_step

ROW_WISE = {
    "drop_missing", "drop_columns", "rename_columns", "filter_rows", "add_missingness_indicator", "text_case",
    "trim_whitespace", "replace_with_null", "round_numeric", "convert_type", "extract_numeric", "validate_format",
    "extract_datetime", "extract_datetime_components",
}


def run_steps_on_stream(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply row-wise steps; any other step raises, as it cannot be left out midway."""
    for step in steps:
        if step.get("operation") not in ROW_WISE:
            raise PreconditionError(f"{step.get('operation')!r} needs a whole table; fit it on a batch")
        stream = run_step(stream, step)
    return stream
