"""Choosing, ordering and paging rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulight.functions.columns import col, data_type, names_where, number, text_sql, value, value_sql
from tabulight.operators.filters import apply_filters, search_text
from tabulight.plans.profile import column_profile, fetched, literal_rows

COPIES_PER_ROW = 100_000
COPIES = "_copies"
#: So many rows may be skipped by one task; a page beyond is looked up between this many cuts at a time.
PAGED_ROWS, PAGE_CUTS, DRAW_SEED = 10_000, 64, 7


def head(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """First n rows in key order."""
    return df.orderBy(*[col(k) for k in key]).limit(n)


def top_n(df: DataFrame, metric: str, n: int = 10, key: list[str] = ()) -> DataFrame:
    """Rows with the n largest values of the metric; NULLs never qualify, key decides ties."""
    v = number(df, metric)
    return df.where(v.isNotNull()).orderBy(v.desc(), *[col(k) for k in key]).limit(n)


def bottom_n(df: DataFrame, metric: str, n: int = 10, key: list[str] = ()) -> DataFrame:
    v = number(df, metric)
    return df.where(v.isNotNull()).orderBy(v.asc(), *[col(k) for k in key]).limit(n)


def top_bottom_summary(df: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """(metric, top_mean, bottom_mean, gap) over the n highest and n lowest values."""
    values = df.select(number(df, metric).alias("v")).where("v is not null")
    ends = (
        values.orderBy(F.desc("v")).limit(n).select("v", F.lit("top").alias("end"))
        .unionByName(values.orderBy("v").limit(n).select("v", F.lit("bottom").alias("end")))
    )
    top, bottom = F.avg(F.when(F.col("end") == "top", F.col("v"))), F.avg(F.when(F.col("end") == "bottom", F.col("v")))
    return ends.agg(
        F.lit(metric).alias("metric"), F.round(top, 4).alias("top_mean"),
        F.round(bottom, 4).alias("bottom_mean"), F.round(top - bottom, 4).alias("gap"),
    )


def _terms(df: DataFrame, sort: str | None, direction: str, key: list[str]) -> list[tuple[Column, bool]]:
    """(column, descending) in the order of their weight."""
    chosen = [(col(sort), direction.upper() == "DESC")] if sort in df.columns else []
    return chosen + [(col(k), False) for k in key]


def _order(terms: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc() if down else c.asc() for c, down in terms]


def sort_by(df: DataFrame, sort: str, direction: str = "ASC", key: list[str] = ()) -> DataFrame:
    """Ascending unless DESC is asked for; an unknown column leaves the order alone."""
    return df.orderBy(*_order(_terms(df, sort, direction, list(key)))) if sort in df.columns else df


def page(df: DataFrame, page: int = 1, size: int = 20, sort: str | None = None,
         direction: str = "ASC", key: list[str] = ()) -> DataFrame:
    """One page of the rows in order; a deep one is looked up in a counted range, so no task holds all rows before it."""
    terms, skipped = _terms(df, sort, direction, list(key)), (max(1, page) - 1) * size
    if skipped > PAGED_ROWS and terms and all(isinstance(f.dataType, T.AtomicType) for f in df.select(*[c for c, _ in terms]).schema):
        df, skipped = _range_of(df, terms, skipped, size)
    return (df.orderBy(*_order(terms)) if terms else df).offset(skipped).limit(size)


def _before(terms: list[tuple[Column, bool]], values: tuple, cut: list[Column]) -> Column:
    """Whether a row comes before the known cut, NULL first, or last descending; in comparisons that reach the file scan."""
    earlier = F.lit(False)
    for (c, down), value_, at in reversed(list(zip(terms, values, cut))):
        if value_ is None:
            ahead = c.isNotNull() if down else F.lit(False)
        else:
            ahead = F.coalesce(c > at, F.lit(False)) if down else c.isNull() | (c < at)
        earlier = ahead | (c.eqNullSafe(at) & earlier)
    return earlier


def _place(before: list[Column], first: int = 0) -> Column:
    """How many cuts are not after a row, by halving: it is compared with six of 64."""
    if not before:
        return F.lit(first)
    middle = len(before) // 2
    return F.when(before[middle], _place(before[:middle], first)).otherwise(_place(before[middle + 1:], first + middle + 1))


def _range_of(df: DataFrame, terms: list[tuple[Column, bool]], skipped: int, size: int) -> tuple[DataFrame, int]:
    """Rows around a page, and how many of them come before it.

    Rows drawn at random cut the order, one scan counts the rows between the cuts, and the two cuts
    around the page enclose it; again until few rows are left. The draw decides how fast that goes, not the result.
    Rows that no term tells apart stay together.
    """
    keys = [c.alias(f"k{i}") for i, (c, _) in enumerate(terms)]
    order = _order([(F.col(f"k{i}"), down) for i, (_, down) in enumerate(terms)])
    kinds = [f.dataType for f in df.select(*keys).schema]
    rows, left = df, None
    while left is None or left > PAGED_ROWS + 2 * size:
        drawn = rows.select(*keys, F.rand(DRAW_SEED).alias("draw")).orderBy("draw").limit(PAGE_CUTS).orderBy(*order).collect()
        cuts = [[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(kind) for v, kind in zip(r, kinds)] for r in drawn]
        if not cuts:
            break
        place = _place([_before(terms, r, cut) for r, cut in zip(drawn, cuts)])
        found = {r["place"]: r["count"] for r in rows.groupBy(place.alias("place")).count().collect()}
        before = list(accumulate(found.get(i, 0) for i in range(len(cuts) + 1)))        # rows before cut i; the last is all rows
        first = max((i for i in range(len(cuts)) if 0 < before[i] <= skipped), default=None)
        last = min((i for i in range(len(cuts)) if skipped + size <= before[i] < before[-1]), default=None)
        if first is None and last is None:
            break
        left = (before[-1] if last is None else before[last]) - (0 if first is None else before[first])
        if last is not None:
            rows = rows.where(_before(terms, drawn[last], cuts[last]))
        if first is not None:
            rows, skipped = rows.where(~_before(terms, drawn[first], cuts[first])), skipped - before[first]
    return rows, skipped


def drill_table(
    df: DataFrame, schema: dict[str, str], filters: dict | None = None, search: str = "",
    sort: str | None = None, direction: str = "ASC", page_number: int = 1, size: int = 20,
    key: list[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(one page of matching rows, one-row frame with their total count)."""
    matching = search_text(apply_filters(df, filters or {}), search, schema)
    return (
        page(matching, page_number, size, sort, direction, key),
        matching.agg(F.count("*").alias("total_count")),
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(col(name)).dropna().distinct()


def named_column(question: str, columns: list[str], default: list[str]) -> str | None:
    """The first column that a question names, or that contains one of its words."""
    q = question.lower()
    for c in columns:
        if c.lower() in q or any(w in c.lower() for w in q.split()):
            return c
    return default[0] if default else None


def sample_values(df: DataFrame, k: int = 3) -> DataFrame:
    """(column, rank, sample): the k smallest distinct values of each column as text.

    Each round takes the smallest value above the previous one, for all columns in one
    aggregate without a shuffle; long text is cut at 100 characters for display only.
    """
    columns = names_where(df, lambda d, c: isinstance(data_type(d, c), T.AtomicType))
    last: dict[str, str] = {}
    samples = []

    def above(c: str) -> str:
        v = value_sql(df, c)
        return f"case when {v} > cast({text_sql(last[c])} as {data_type(df, c).simpleString()}) then {v} end" if c in last else v

    for rank in range(1, k + 1):
        smallest = column_profile(df, columns, {"sample": ("string", lambda c: f"min({above(c)})")})
        last = {r["column"]: r["sample"] for r in smallest.where("sample is not null").collect()}
        samples += [(c, rank, s[:100] + "..." if len(s) > 100 else s) for c, s in last.items()]
        columns = list(last)
    return literal_rows(df, samples, "column string, rank int, sample string")


def repeated_rows(df: DataFrame) -> DataFrame:
    """The distinct rows that occur more than once, and how often (column COPIES); NaN equals NULL.

    Rows are first counted by two 64-bit hashes, 16 bytes each in the shuffle. Only rows whose
    hashes repeat are then grouped in full, so equal hashes of different rows do no harm.
    """
    rows = df.select(*[value(df, c).alias(c) for c in df.columns])
    every = [col(c) for c in df.columns]
    marked = rows.withColumn("_h1", F.xxhash64(*every)).withColumn("_h2", F.xxhash64(F.lit(1), *every))
    again = marked.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return marked.join(again, ["_h1", "_h2"], "left_semi").groupBy(*every).agg(F.count("*").alias(COPIES)).where(F.col(COPIES) > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every copy of every fully duplicated row; NaN equals NULL and is shown as NULL.

    Copies are counted and written out again from (row, count), so one row that makes up a
    large part of the table never has to meet in one task: long counts are cut into pieces
    that are spread before they are expanded.
    """
    copies = repeated_rows(df).withColumnRenamed(COPIES, "_n")
    pieces = copies.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES_PER_ROW).cast("long")))
    )
    size = F.least(F.lit(COPIES_PER_ROW), F.col("_n") - F.col("_piece"))
    total = copies.agg(F.sum("_n")).first()[0] or 0
    spread = pieces.withColumn("_size", size).drop("_n", "_piece").repartition(max(1, -(-total // COPIES_PER_ROW)))
    return (
        spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))))
        .select(*[col(c) for c in df.columns])
    )


def scatter_points(df: DataFrame, x: str, y: str, key: list[str], n: int = 300) -> DataFrame:
    """(x, y) of n rows drawn from all rows that have both; none if the table has up to 5 rows.

    Drawn are those with the smallest MD5 of their key.
    """
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y"), F.md5(key_text(key).cast("binary")).alias("_draw"), *[
        col(k).alias(f"_k{i}") for i, k in enumerate(key)]).where("x is not null and y is not null")
    drawn = fetched(pairs.orderBy("_draw", *[f"_k{i}" for i in range(len(key))], "x", "y").limit(n).select("x", "y"))
    return drawn if df.limit(6).count() > 5 else drawn.limit(0)


def key_text(key: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key])
