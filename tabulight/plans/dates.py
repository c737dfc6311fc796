"""Dates of a column read in one format.

"03/04/2024" alone can be two days. A column has one format: the one that fits most of its
values, the first in the list on ties, found in one scan of that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulight.functions import vocab
from tabulight.functions.columns import is_text, name_sql, text_timestamp_sql, timestamp_sql
from tabulight.plans.profile import column_profile

Format = tuple[str, str]


def format_counts(df: DataFrame, names: list[str]) -> dict[str, list[int]]:
    """For each text column the number of values that each known format fits."""
    metrics = {f"f{i}": ("bigint", lambda c, f=f: f"count({text_timestamp_sql(name_sql(c), [f])})") for i, f in enumerate(vocab.DATE_FORMATS)}
    return {r["column"]: [r[m] for m in metrics] for r in column_profile(df, names, metrics).collect()} if names else {}


def best_format(counts: list[int]) -> Format | None:
    """The format that fits most; None if none fits any value."""
    most = max(counts)
    return vocab.DATE_FORMATS[counts.index(most)] if most else None


def dated_sql(df: DataFrame, name: str) -> str:
    """SQL of the column as timestamp: a text column in its own format, other types as they are."""
    if not is_text(df, name):
        return timestamp_sql(df, name)
    found = best_format(format_counts(df, [name])[name])
    return text_timestamp_sql(name_sql(name), [found]) if found else "cast(null as timestamp_ntz)"


def dated(df: DataFrame, name: str) -> Column:
    return F.expr(dated_sql(df, name))
