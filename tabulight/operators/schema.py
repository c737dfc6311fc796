"""Semantic column types and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tabulight.functions import vocab
from tabulight.functions.columns import (
    col, data_type, is_boolean, is_datetime, is_numeric, is_text, name_sql, names_where, number_sql, strip_sql,
    text_number_sql, texts_sql, timestamp_sql,
)
from tabulight.plans.dates import format_counts
from tabulight.plans.profile import column_profile, distinct_profile, literal_rows

NUM_SHARE, DATE_SHARE, MIXED_SHARE, MIXED_MIN = 0.90, 0.80, 0.20, 5
CLASS_SHARE, CLASS_MIN = 0.3, 10


def classify_columns(df: DataFrame) -> DataFrame:
    """(column, class, position): numeric, date or categorical, by how many values parse.

    Text needs at least max(10, 30 % of the rows) parseable values to count as numeric or date.
    """
    counted = column_profile(df, df.columns, {
        "n": ("bigint", lambda c: "count(*)"),
        "numbers": ("bigint", lambda c: f"count({number_sql(df, c)})" if is_text(df, c) else "0L"),
        "dates": ("bigint", lambda c: f"count({timestamp_sql(df, c)})" if is_text(df, c) else "0L"),
    })
    enough = F.greatest(F.lit(CLASS_MIN), F.floor(F.col("n") * CLASS_SHARE))
    native_numeric = names_where(df, lambda d, c: is_numeric(d, c) or is_boolean(d, c))
    native_date = names_where(df, is_datetime)
    kind = (
        F.when(F.col("column").isin(native_numeric), "numeric")
        .when(F.col("column").isin(native_date), "date")
        .when(F.col("numbers") >= enough, "numeric")
        .when(F.col("dates") >= enough, "date")
        .otherwise("categorical")
    )
    return counted.select("column", kind.alias("class"), "position")


def column_classes(df: DataFrame) -> dict[str, list[str]]:
    """The classes as lists of names in table order (one row per column is fetched)."""
    rows = sorted(classify_columns(df).collect(), key=lambda r: r["position"])
    return {k: [r["column"] for r in rows if r["class"] == k] for k in ("numeric", "date", "categorical")}


def detect_schema(df: DataFrame) -> DataFrame:
    """(column, type, position) with type NUM, TEXT, DATE, BOOL or MIXED."""
    types = semantic_types(df)
    return literal_rows(
        df, [(c, types[c], i) for i, c in enumerate(df.columns)], "column string, type string, position int"
    )


def semantic_types(df: DataFrame) -> dict[str, str]:
    """Two scans at most: parse counts first, then distinct flags and date formats where still open."""
    texts, integers = names_where(df, is_text), names_where(df, lambda d, c: isinstance(data_type(d, c), T.IntegralType))
    flag_word = lambda c: f"lower({strip_sql(name_sql(c))}) in ({texts_sql(vocab.BOOLEAN_WORDS)})"
    facts = {
        r["column"]: r for r in column_profile(df, texts + integers, {
            "filled": ("bigint", lambda c: f"count({name_sql(c)})"),
            "numbers": ("bigint", lambda c: f"count({text_number_sql(name_sql(c)) if c in texts else name_sql(c)})"),
            "not_flags": ("bigint", lambda c: f"count_if(not {flag_word(c)})" if c in texts else f"count_if({name_sql(c)} not in (0, 1))"),
        }).collect()
    }
    # only spellings of a few words are left in these columns, so counting them is cheap
    maybe_flags = [c for c, f in facts.items() if f["filled"] and not f["not_flags"]]
    distinct = distinct_profile(df, maybe_flags, name_sql)
    flags = [r["column"] for r in distinct.collect() if r["distinct_count"] in (2, 3)] if maybe_flags else []
    dates = [c for c in texts if facts[c]["filled"] and c not in flags and facts[c]["numbers"] < NUM_SHARE * facts[c]["filled"]]
    date_counts = {}
    if dates:
        date_counts = {c: max(counts) for c, counts in format_counts(df, dates).items()}

    def kind(c: str) -> str:
        if is_boolean(df, c) or c in flags:
            return "BOOL"
        if is_numeric(df, c):
            return "NUM"
        if is_datetime(df, c):
            return "DATE"
        f = facts.get(c)
        if not f or not f["filled"]:
            return "TEXT"
        share = f["numbers"] / f["filled"]
        if share >= NUM_SHARE:
            return "NUM"
        if date_counts.get(c, 0) / f["filled"] >= DATE_SHARE:
            return "DATE"
        return "MIXED" if f["filled"] >= MIXED_MIN and share >= MIXED_SHARE else "TEXT"

    return {c: kind(c) for c in df.columns}


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, type_a, type_b) where two (column, type) frames disagree; MISSING if absent."""
    left = a.select("column", F.col("type").alias("type_a"))
    right = b.select("column", F.col("type").alias("type_b"))
    return (
        left.join(right, "column", "full_outer")
        .na.fill("MISSING", ["type_a", "type_b"])
        .where(F.col("type_a") != F.col("type_b"))
    )


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Repeatable sample: the n rows with the smallest MD5 of key and seed, whatever the partitioning.

    Rows with equal keys have equal hashes and follow each other by all their columns. Spark keeps
    only n rows of each task, so nothing is ordered as a whole.
    """
    text = F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    return df.orderBy(F.md5(text.cast("binary")), *[col(c) for c in df.columns]).limit(n)
