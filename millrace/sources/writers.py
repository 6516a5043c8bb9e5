"""Writers. Each task writes its own part file into the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One record per line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, file_format: str, mode: str = "error") -> None:
    writers = {"csv": write_csv, "json": write_json}
    if file_format not in writers:
        raise ValueError(f"unsupported export format {file_format!r}")
    writers[file_format](df, path, mode)
