"""One wide aggregate per table, turned into one row per column.

Profiling a table column by column would scan it once per column. Here every metric of
every column is an aggregate of the same scan; the single wide row is then spread into
(column, position, metrics...) rows. Metrics are written as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tabulight.functions.columns import double_sql, name_sql, text_sql

MAX_AGGREGATES = 200  # beyond this one scan is split in several, to keep generated code small

AsSql = Callable[[str], str]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _literal(v, kind: T.DataType) -> str:
    if v is None:
        return f"cast(null as {kind.simpleString()})"
    if isinstance(kind, T.StringType):
        return text_sql(v)
    return double_sql(v) if isinstance(kind, T.DoubleType) else f"cast({v!r} as {kind.simpleString()})"


def literal_rows(df: DataFrame, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A frame of facts already known on the driver (at most a few per column).

    Written as VALUES where the types allow it: Spark then knows the rows while planning and
    starts no tasks to read them.
    """
    spark = df.sparkSession
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = [f.dataType for f in struct]
    simple = all(isinstance(k, (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType)) for k in kinds)
    if not rows or not simple:
        return spark.createDataFrame(rows, struct)
    values = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(name_sql(f.name) for f in struct)})")


def fetched(frame: DataFrame) -> DataFrame:
    """The same rows as a local frame, so that several uses do not read the table again.

    Only for results whose size does not grow with the table: a few rows per column, month,
    chart point or rule.
    """
    return literal_rows(frame, frame.collect(), frame.schema)


def struct_sql(**fields: str) -> str:
    return "struct(" + ", ".join(f"{sql} as `{name}`" for name, sql in fields.items()) + ")"


def inline_sql(structs: list[str]) -> str:
    """One output row per struct of the same shape."""
    return f"inline(array({', '.join(structs)}))"


def column_profile(
    df: DataFrame, columns: list[str], metrics: dict[str, tuple[str, AsSql]], per_scan: int | None = None,
) -> DataFrame:
    """(column, position, *metrics); a metric is (SQL type, column name -> aggregate SQL)."""
    if not columns:
        fields = ", ".join(f"`{name}` {kind}" for name, (kind, _) in metrics.items())
        return empty_like(df, f"column string, position int, {fields}")
    per_scan = per_scan or max(1, MAX_AGGREGATES // max(1, len(metrics)))
    position = {c: i for i, c in enumerate(df.columns)}
    frames = []
    for start in range(0, len(columns), per_scan):
        batch = columns[start:start + per_scan]
        wide = df.agg(*[
            F.expr(f"cast({make(c)} as {kind}) as `{i}_{name}`")
            for i, c in enumerate(batch) for name, (kind, make) in metrics.items()
        ])
        frames.append(wide.selectExpr(inline_sql([
            struct_sql(column=text_sql(c), position=str(position[c]), **{name: f"`{i}_{name}`" for name in metrics})
            for i, c in enumerate(batch)
        ])))
    return union_all(frames)


def value_counts(df: DataFrame, name: str, as_value: AsSql) -> DataFrame:
    """(value, n) of one column without NULL: equal values merge before the shuffle."""
    return df.selectExpr(f"{as_value(name)} as value").where("value is not null").groupBy("value").agg(
        F.count("*").alias("n"))


def _per_column(df: DataFrame, columns: list[str], as_value: AsSql, result: str) -> DataFrame:
    """One aggregate of the value counts per column, all in one query.

    Each column is read and shuffled on its own, in its own type. That reads the same bytes as
    one scan of a columnar file and avoids a copy of every row per column.
    """
    return union_all([
        value_counts(df, c, as_value).agg(F.expr(result)).select(F.lit(c).alias("column"), "*") for c in columns])


def narrow_sql(df: DataFrame, sql: str) -> str:
    """A value to tell values apart by: itself, but for texts of more than 32 bytes their SHA-256, so that no long text is shuffled."""
    if df.selectExpr(f"{sql} as value").schema["value"].dataType.simpleString() not in ("string", "binary"):
        return sql
    return f"if(octet_length({sql}) <= 32, concat(X'00', cast({sql} as binary)), concat(X'01', unhex(sha2(cast({sql} as binary), 256))))"


def distinct_profile(df: DataFrame, columns: list[str], as_value: AsSql, approx: bool = False) -> DataFrame:
    """(column, distinct_count) for non-null values; exact unless ``approx``. Long texts are told apart by their digests."""
    if approx or not columns:
        return column_profile(df, columns, {
            "distinct_count": ("bigint", lambda c: f"approx_count_distinct({as_value(c)})")}).drop("position")
    return _per_column(df, columns, lambda c: narrow_sql(df, as_value(c)), "count(*) as distinct_count")


def column_modes(df: DataFrame, columns: list[str], as_value: AsSql) -> DataFrame:
    """(column, mode): most frequent value, smallest on ties; no map of all values anywhere."""
    return _per_column(df, columns, as_value, "min_by(value, struct(-n, value)) as mode")
