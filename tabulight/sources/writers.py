"""Result tables to files, written in parallel by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabulight.operators.filters import apply_filters, json_safe, search_text
from tabulight.operators.rows import sort_by


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every cell comes back as it was: outer white space stays, quotes are doubled, an empty text is \"\" and NULL is nothing."""
    df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""', nullValue="").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with ISO dates; NaN and infinities are written as null."""
    json_safe(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    if fmt == "csv":
        write_csv(df, path, mode)
    elif fmt == "json":
        write_json(df, path, mode)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}: choose csv, json or parquet")


def export_filtered(
    df: DataFrame, path: str, schema: dict[str, str], filters: dict | None = None, search: str = "",
    sort: str | None = None, direction: str = "ASC", fmt: str = "csv", mode: str = "errorifexists",
) -> None:
    """All rows the dashboard table would page through."""
    rows = search_text(apply_filters(df, filters or {}), search, schema)
    _write(sort_by(rows, sort, direction) if sort else rows, path, fmt, mode)


def export_cleaned(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """A repaired table without its repair marks."""
    _write(df.drop("was_missing", "old_value"), path, fmt, mode)
