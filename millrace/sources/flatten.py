"""Nested columns as flat columns named by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..frame import PreconditionError, aggregate_row, col, require_columns


def flatten(df: DataFrame, sep: str = ".", max_columns: int | None = None) -> DataFrame:
    """Structs become ``a.b`` and arrays ``a.0``, ``a.1``, …, level by level.

    Array widths come from one aggregate per nesting level. A column ``a`` is
    dropped when a column ``a.…`` exists. More than ``max_columns`` are refused, if
    it is given.
    """
    while True:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        arrays = [n for n, k in kinds.items() if isinstance(k, T.ArrayType)]
        if not arrays and not any(isinstance(k, T.StructType) for k in kinds.values()):
            return _drop_parents(df, sep)
        widths = aggregate_row(df, {n: F.max(F.size(col(n))) for n in arrays})
        out = []
        for name, kind in kinds.items():
            if isinstance(kind, T.StructType):
                out += [col(name)[f.name].alias(f"{name}{sep}{f.name}") for f in kind.fields]
            elif isinstance(kind, T.ArrayType):
                out += [F.get(col(name), i).alias(f"{name}{sep}{i}") for i in range(widths[name] or 0)]
            else:
                out.append(col(name))
        if max_columns and len(out) > max_columns:
            raise PreconditionError(f"flattening gives {len(out)} columns; explode the long arrays instead")
        df = df.select(*out)


def _drop_parents(df: DataFrame, sep: str) -> DataFrame:
    parents = set()
    for name in df.columns:
        parts = name.split(sep)
        parents |= {sep.join(parts[:i]) for i in range(1, len(parts))}
    return df.drop(*[c for c in df.columns if c in parents])


def flatten_json_column(df: DataFrame, column: str, schema: str | T.DataType | None = None,
                        sep: str = ".") -> DataFrame:
    """Replace a JSON text column by its flattened fields ``{column}.…``.

    Without a schema one aggregate merges the schemas of all texts. Text that is
    not JSON gives nulls.
    """
    require_columns(df, [column])
    if schema is None:
        found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(column)))).first()[0]
        schema = found.replace("OBJECT<", "STRUCT<")
        if not schema.startswith(("STRUCT<", "ARRAY<")):
            raise PreconditionError(f"column {column!r} does not hold JSON objects or lists")
    return flatten(df.withColumn(column, F.from_json(col(column), schema)), sep)
