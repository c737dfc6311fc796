"""Finding, filling and restoring missing values. Tables are never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulight.functions.columns import col, count_if, data_type, is_missing, number, number_sql, value
from tabulight.operators.quality import missing_panel
from tabulight.plans.quantiles import quantiles

METHODS = ("mean", "median", "mode", "custom", "null")


def _gap(df: DataFrame, name: str) -> Column:
    return is_missing(df, name, "M2", none_word=True)


def _mode(df: DataFrame, name: str, as_value: Column) -> DataFrame:
    """(mode): most frequent present value, smallest on ties."""
    present = df.where(~_gap(df, name)).select(as_value.alias("v")).where("v is not null")
    return present.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).select(F.col("v").alias("mode"))


def missing_detail(df: DataFrame, name: str, schema: dict[str, str]) -> DataFrame:
    """(total_rows, missing_count, mean, median, mode): mean and median for NUM columns only."""
    numeric = schema.get(name) == "NUM"
    v = number(df, name)
    mean = F.round(F.avg(F.when(~_gap(df, name), v)), 2) if numeric else F.max(F.lit(None).cast("double"))
    median = quantiles(df, [name], [0.5], lambda c: number_sql(df, c))[name][0] if numeric else None
    mode = _mode(df, name, v if numeric else col(name).cast("string"))
    shown = F.round(mode.scalar(), 2).cast("string") if numeric else mode.scalar()
    return df.agg(F.count("*").alias("total_rows"), count_if(_gap(df, name)).alias("missing_count"), mean.alias("mean")).select(
        F.lit(name).alias("column"), "total_rows", "missing_count", "mean",
        F.round(F.lit(median).cast("double"), 2).alias("median"), shown.alias("mode"))


def missing_preview(df: DataFrame, name: str, key: list[str], limit: int = 100) -> DataFrame:
    """The first values in key order, each with its missing mark."""
    return df.orderBy(*[col(k) for k in key]).limit(limit).select(
        *[col(k) for k in key], F.when(~_gap(df, name), col(name).cast("string")).alias("value"), _gap(df, name).alias("is_missing"))


def _replacement(df: DataFrame, name: str, method: str, custom, schema: dict[str, str]) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: choose one of {', '.join(METHODS)}")
    kind = data_type(df, name)
    if method == "null":
        return F.lit(None).cast(kind)
    if method == "custom":
        if custom is None or str(custom).strip() == "":
            raise ValueError("the replacement value must not be empty")
        return F.lit(custom).cast(kind)
    numeric = schema.get(name) == "NUM"
    if method in ("mean", "median") and not numeric:
        raise ValueError(f"{method} needs a numeric column, {name!r} is {schema.get(name)}")
    v = number(df, name)
    if method == "mean":
        return F.round(df.agg(F.avg(v)).scalar(), 2).cast(kind)
    if method == "median":
        return F.round(F.lit(quantiles(df, [name], [0.5], lambda c: number_sql(df, c))[name][0]).cast("double"), 2).cast(kind)
    mode = _mode(df, name, v if numeric else value(df, name)).scalar()
    return (F.round(mode, 2) if numeric else mode).cast(kind)


def fill_missing(df: DataFrame, name: str, method: str, custom=None, schema: dict[str, str] | None = None) -> DataFrame:
    """The table with missing cells of one column replaced, plus a ``was_missing`` mark and the ``old_value``.

    The replacement is one value: a scalar subquery for mean and mode, a literal otherwise, so
    the fill itself is a projection without a shuffle.
    """
    new = _replacement(df, name, method, custom, schema or {})
    filled = F.when(_gap(df, name), new).otherwise(col(name)).alias(name)
    return df.select(*[filled if c == name else col(c) for c in df.columns], _gap(df, name).alias("was_missing"),
                     F.when(_gap(df, name), col(name)).alias("old_value"))


def fill_preview(df: DataFrame, name: str, method: str, key: list[str], custom=None,
                 schema: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """(key, old, new, affected_rows) of the first missing cells; nothing is replaced."""
    new = _replacement(df, name, method, custom, schema or {}).cast("string")
    affected = df.agg(count_if(_gap(df, name))).scalar()
    return df.where(_gap(df, name)).orderBy(*[col(k) for k in key]).limit(limit).select(
        *[col(k) for k in key], F.coalesce(col(name).cast("string"), F.lit("[EMPTY]")).alias("old"),
        F.coalesce(new, F.lit("NULL")).alias("new"), affected.alias("affected_rows"))


def fill_summary(df: DataFrame, name: str, method: str, schema: dict[str, str], custom=None) -> DataFrame:
    """The missing panel as it looks after the repair."""
    return missing_panel(fill_missing(df, name, method, custom, schema).drop("was_missing", "old_value"), schema)


def undo_fill(filled: DataFrame, name: str) -> DataFrame:
    """The filled table with exactly the marked cells set back to their old value: a projection."""
    columns = [c for c in filled.columns if c not in ("was_missing", "old_value")]
    return filled.select(*[F.when(F.col("was_missing"), F.col("old_value")).otherwise(col(c)).alias(c) if c == name else col(c) for c in columns])
