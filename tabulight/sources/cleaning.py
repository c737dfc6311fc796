"""Standard cleaning of a freshly read table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tabulight.functions import vocab
from tabulight.functions.columns import (
    is_text, name_sql, names_where, strip_sql, text_number_sql, texts_sql, value_sql,
)
from tabulight.plans.profile import column_profile


def null_sentinels(df: DataFrame, sentinels: list[str] = vocab.NULL_SENTINELS) -> DataFrame:
    """Text cells that are exactly one of the tokens become NULL."""
    return _with_texts(df, lambda c: f"case when {c} not in ({texts_sql(sentinels)}) then {c} end")


def _with_texts(df: DataFrame, change, names: list[str] | None = None) -> DataFrame:
    """The table with each text column replaced by an expression of it."""
    names = names_where(df, is_text) if names is None else names
    return df.selectExpr(*[
        f"{change(name_sql(c))} as {name_sql(c)}" if c in names else name_sql(c) for c in df.columns])


def clean_names(names: list[str]) -> list[str]:
    """Word characters only, never blank, unique even when case is ignored."""
    taken: set[str] = set()
    result = []
    for i, raw in enumerate(names):
        name = re.sub(r"[\s_]+", "_", re.sub(r"[^\w\s]", "_", str(raw).strip())).strip("_")
        if str(raw).strip().lower() in ("nan", "none", "null", "unnamed") or not name:
            name = f"column_{i}"
        unique, k = name, 0
        while unique.lower() in taken:
            k += 1
            unique = f"{name}_{k}"
        taken.add(unique.lower())
        result.append(unique)
    return result


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are all NULL, then without rows that are all NULL."""
    filled = column_profile(df, df.columns, {"n": ("bigint", lambda c: f"count({value_sql(df, c)})")})
    keep = {r["column"] for r in filled.where("n > 0").collect()}
    return df.selectExpr(*[name_sql(c) for c in df.columns if c in keep]).na.drop("all")


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Text columns in which every non-null value is a number become double."""
    texts = names_where(df, is_text)
    numeric = column_profile(df, texts, {
        "filled": ("bigint", lambda c: f"count({name_sql(c)})"),
        "numbers": ("bigint", lambda c: f"count({text_number_sql(name_sql(c))})"),
    })
    convert = [r["column"] for r in numeric.where("filled > 0 AND filled = numbers").collect()]
    return _with_texts(df, text_number_sql, convert)


def strip_strings(df: DataFrame) -> DataFrame:
    """Text without outer whitespace; blank, "nan" and "None" become NULL."""
    return _with_texts(
        df, lambda c: f"case when {strip_sql(c)} not in ('', 'nan', 'None') then {strip_sql(c)} end")


def clean_table(df: DataFrame) -> DataFrame:
    """Clean names, drop empty columns and rows, turn numeric text into numbers, strip text."""
    return strip_strings(coerce_numeric(drop_empty(df.toDF(*clean_names(df.columns)))))
