"""Small helpers on DataFrames shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class PreconditionError(ValueError):
    """The table does not meet what an operator asks for."""


class MissingColumnError(ValueError):
    """A requested column is not in the table."""


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its literal name, also when the name holds dots."""
    return F.col(quote(name))


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DoubleType, T.FloatType))


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.IntegralType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.StringType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def resolve_columns(df: DataFrame, names) -> list[str]:
    """Requested names as the table spells them; unknown names raise."""
    by_lower = {c.lower(): c for c in df.columns}
    present = set(df.columns)
    found = [n if n in present else by_lower.get(str(n).lower()) for n in names or []]
    unknown = [n for n, f in zip(names or [], found) if f is None]
    if unknown:
        raise MissingColumnError(f"columns {unknown} are not in the table")
    return found


def require_columns(df: DataFrame, names) -> None:
    unknown = [n for n in names or [] if n not in df.columns]
    if unknown:
        raise PreconditionError(f"columns {unknown} are not in the table")


def require_numeric(df: DataFrame, names) -> None:
    require_columns(df, names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise PreconditionError(f"columns {wrong} are not numeric")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_fractional(df, name) else c


def nullify_nan(df: DataFrame, columns=None) -> DataFrame:
    names = [c for c in columns or df.columns if is_fractional(df, c)]
    return df.withColumns({n: value(df, n) for n in names}) if names else df


def number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as null."""
    return value(df, name).cast("double")


def orderable(df: DataFrame, name: str) -> Column:
    """The column, as JSON text when its type has no ordering (maps, variants)."""
    return F.to_json(col(name)) if has_map(data_type(df, name)) else col(name)


def has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.StructType):
        return any(has_map(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return has_map(dt.elementType)
    return isinstance(dt, (T.MapType, T.VariantType))


def chunks(items, size: int):
    return [items[i : i + size] for i in range(0, len(items), size)]


def in_parallel(spark: SparkSession, jobs: list, workers: int = 8) -> list:
    """Results of independent Spark jobs that are submitted side by side."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda run: run(), [inheritable_thread_target(spark)(job) for job in jobs]))


def aggregate_row(df: DataFrame, exprs: dict, size: int = 40) -> dict:
    """Evaluate named aggregates and return one dict.

    Long lists are cut into several aggregates: one plan with hundreds of
    statistics outgrows what the JVM compiles and runs many times slower. Each
    part reads only its own columns.
    """

    def run(part):
        row = df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(part)]).first()
        return {name: row[i] for i, (name, _) in enumerate(part)}

    parts = chunks(list(exprs.items()), size)
    return {k: v for got in in_parallel(df.sparkSession, [partial(run, p) for p in parts]) for k, v in got.items()}


def shared_folder(df: DataFrame) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there."""
    shared_folder(df)
    return df.checkpoint()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers then find it wherever the driver was started. Nothing is sent when the
    package itself came as an archive, as with ``--py-files``.
    """
    sc, root = spark.sparkContext, Path(__file__).parent
    if getattr(sc, "_sent_code_of", None) == root or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._sent_code_of = root
