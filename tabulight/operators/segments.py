"""Categories, segments and the aggregates behind dashboard charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulight.functions.columns import col, number, number_sql, percent, text_sql, value, value_sql
from tabulight.operators.filters import apply_filters, resolve_name, search_text
from tabulight.operators.rows import drill_table, scatter_points
from tabulight.plans.dates import dated
from tabulight.plans.profile import column_profile, empty_like, literal_rows, union_all

CATEGORY_VALUES = (2, 50)
SEGMENT_VALUES = (2, 30)
DIVERSE_VALUES = (10, 100)
SERIES_POINTS, TIMELINE_POINTS, BAR_SLICES, PIE_SLICES = 15, 50, 10, 6


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"))


def column_averages(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(column, average) with two decimals."""
    return column_profile(df, numeric, {
        "average": ("double", lambda c: f"round(avg({number_sql(df, c)}), 2)")}).drop("position")


def as_label(df: DataFrame, name: str) -> Column:
    """Group value as text."""
    return value(df, name).cast("string")


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.select(as_label(df, name).alias("value")).where("value is not null").groupBy("value").agg(
        F.count("*").alias("count"))


def value_counts(df: DataFrame, name: str, k: int = 5) -> DataFrame:
    """(end, value, count, pct): the k most and the k least frequent values."""
    counts = _counts(df, name)
    total = df.agg(F.count(value(df, name))).scalar()
    pct = percent(F.col("count"), total).alias("pct")
    pick = lambda end, order: counts.orderBy(order, "value").limit(k).select(F.lit(end).alias("end"), "value", "count", pct)
    return pick("top", F.desc("count")).unionByName(pick("bottom", F.asc("count")))


def _level(pct: Column) -> Column:
    return F.when(pct > 70, "High").when(pct > 40, "Medium").otherwise("Low")


def _groups(df: DataFrame, name: str, position: int, metric: str | None) -> DataFrame:
    """(column, position, value, count, sum, mean, measured) of one column; reads only it and the metric."""
    v = number_sql(df, metric) if metric else "double(null)"
    return (
        df.selectExpr(f"{value_sql(df, name)} as value", f"{v} as v").where("value is not null").groupBy("value")
        .agg(F.expr("count(*) as count"), F.expr("sum(v) as sum"), F.expr("avg(v) as mean"), F.expr("count(v) as measured"))
        .selectExpr(f"{text_sql(name)} as column", f"{position} as position", "cast(value as string) as value",
                    "count", "sum", "mean", "measured")
    )


def _admitted(df: DataFrame, categories: list[str], high: int) -> list[str]:
    """The columns that may have ``high`` distinct values or fewer, from one scan without a shuffle of values.

    A sketch never takes a column with few values for one with many: n values fill n of its m registers at most, and while
    they are few its estimate is m ln(m / empty ones), which is less than n + n^2 / m. So nothing is refused wrongly;
    what is admitted wrongly has hardly more values and is counted in full afterwards.
    """
    if not categories:
        return []
    found = df.agg(*[F.expr(f"approx_count_distinct({value_sql(df, c)}, 0.02) as `{i}`") for i, c in enumerate(categories)]).first()
    return [c for c, n in zip(categories, found, strict=True) if n <= high + high * high // 1000 + 1]


def category_table(df: DataFrame, categories: list[str], metric: str | None = None,
                   allowed: tuple[int, int] = CATEGORY_VALUES) -> DataFrame:
    """(column, position, value, count, sum, mean, measured, values, total, pct) for the columns
    whose number of distinct values is allowed.

    A first scan refuses the columns with more values than allowed by sketches; only the others are grouped. One group more
    than allowed is enough to see that a column has too many after all, so each gives at most ``allowed[1] + 1`` rows;
    these are fetched once and serve all that follows.
    """
    low, high = allowed
    schema = ("column string, position int, value string, count bigint, sum double, mean double, measured bigint, "
              "values bigint, total bigint")
    rows = []
    admitted = {*_admitted(df, categories, high)}
    if admitted:
        found: dict[str, list] = {}
        for r in union_all([_groups(df, c, i, metric).limit(high + 1) for i, c in enumerate(categories) if c in admitted]).collect():
            found.setdefault(r["column"], []).append(tuple(r))
        for groups in found.values():
            if low <= len(groups) <= high:
                rows += [g + (len(groups), sum(x[3] for x in groups)) for g in groups]
    return literal_rows(df, rows, schema).withColumn("pct", percent(F.col("count"), F.col("total")))


def concentration(df: DataFrame, name: str) -> DataFrame:
    """(column, top_3_pct, concentration) for a column with 2 to 50 distinct values."""
    return _concentration(category_table(df, [name]))


def _concentration(table: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))
    top3 = F.when(F.max("values") >= 3, F.sum(F.when(F.col("rank") <= 3, F.col("pct")))).otherwise(0.0)
    return (
        table.withColumn("rank", rank).groupBy("column", "position")
        .agg(F.max("values").alias("unique_values"), F.max("total").alias("total_records"), F.round(top3, 2).alias("top_3_pct"),
             F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
             F.max(F.when(F.col("rank") == 1, F.col("pct"))).alias("top_pct"))
        .withColumn("concentration", _level(F.col("top_3_pct")))
    )


def _extremes(table: DataFrame) -> DataFrame:
    """Best and worst group per column by mean; names decide ties."""
    measured = table.where("measured > 0")
    best = F.min_by(F.struct("value", "mean", "sum"), F.struct((-F.col("mean")).alias("m"), F.col("value")))
    worst = F.max_by(F.struct("value", "mean", "sum"), F.struct((-F.col("mean")).alias("m"), F.col("value")))
    return measured.groupBy("column", "position").agg(
        best.alias("best"), worst.alias("worst"), F.sum("sum").alias("total_sum"), F.count("*").alias("segments"))


def category_metric(df: DataFrame, name: str, metric: str, allowed: tuple[int, int] = CATEGORY_VALUES) -> DataFrame:
    """(column, best, best_mean, best_sum, contribution_pct, worst, worst_mean, worst_sum)."""
    return _performers(category_table(df, [name], metric, allowed))


def _performers(table: DataFrame) -> DataFrame:
    return _extremes(table).where("total_sum > 0").select(
        "column", F.col("best.value").alias("best"), F.round("best.mean", 4).alias("best_mean"),
        F.round("best.sum", 2).alias("best_sum"), percent(F.col("best.sum"), F.col("total_sum")).alias("contribution_pct"),
        F.col("worst.value").alias("worst"), F.round("worst.mean", 4).alias("worst_mean"),
        F.round("worst.sum", 2).alias("worst_sum"))


def category_analysis(df: DataFrame, categories: list[str], metric: str | None = None,
                      table: DataFrame | None = None) -> DataFrame:
    """One row per categorical column: concentration, top and rare values, best and worst group."""
    table = category_table(df, categories, metric) if table is None else table
    name = F.struct("value", "count", "pct")
    by = lambda order: F.row_number().over(W.partitionBy("column").orderBy(order, "value"))
    lists = table.withColumn("most", by(F.desc("count"))).withColumn("least", by(F.asc("count"))).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("most") <= 5, F.struct("most", name.alias("v"))))),
                    lambda x: x["v"]).alias("top_categories"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("least") <= 5, F.struct("least", name.alias("v"))))),
                    lambda x: x["v"]).alias("bottom_categories"))
    return _concentration(table).join(F.broadcast(lists), "column").join(F.broadcast(_performers(table)), "column", "left")


def segment_gap(df: DataFrame, categories: list[str], metric: str, allowed: tuple[int, int] = SEGMENT_VALUES) -> DataFrame:
    """Best and worst segment of each column by mean, with their gap."""
    return _gaps(category_table(df, categories, metric, allowed)).where("segments >= 2")


def _gaps(table: DataFrame) -> DataFrame:
    return _extremes(table).select(
        "column", "position", F.col("best.value").alias("best_segment"), F.round("best.mean", 4).alias("best_mean"),
        F.col("worst.value").alias("worst_segment"), F.round("worst.mean", 4).alias("worst_mean"), "segments",
        F.round(F.col("best.mean") - F.col("worst.mean"), 4).alias("performance_gap"))


def segment_extremes(df: DataFrame, categories: list[str], metric: str) -> DataFrame:
    """Like segment_gap without a limit on the number of segments, unrounded."""
    if not categories:
        return empty_like(df, "column string, position int, best string, worst string, segments bigint, "
                              "best_mean double, worst_mean double")
    every = union_all([_groups(df, c, i, metric) for i, c in enumerate(categories)])
    return _extremes(every).select(
        "column", "position", F.col("best.value").alias("best"), F.col("worst.value").alias("worst"), "segments",
        F.col("best.mean").alias("best_mean"), F.col("worst.mean").alias("worst_mean"))


def dominant_category(df: DataFrame, name: str, metric: str) -> DataFrame:
    """(column, category, share_pct, top_sum, total_sum, dominant) by share of the metric's sum."""
    sums = df.select(as_label(df, name).alias("value"), number(df, metric).alias("v")).where("value is not null").groupBy(
        "value").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"))
    top = F.min_by(F.struct("value", "s"), F.struct((-F.col("s")).alias("s"), F.col("value")))
    share = F.col("top.s") / F.col("total") * 100
    return sums.agg(top.alias("top"), F.sum("s").alias("total")).where("total > 0").select(
        F.lit(name).alias("column"), F.col("top.value").alias("category"), F.round(share, 2).alias("share_pct"),
        F.round("top.s", 2).alias("top_sum"), F.round("total", 2).alias("total_sum"), (share > 40).alias("dominant"))


def diverse_segment(distinct: DataFrame, categories: list[str]) -> DataFrame:
    """(column, distinct_count): the categorical column with the most values within 10..100."""
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("column")) if categories else F.lit(0)
    return distinct.where(F.col("column").isin(categories) & F.col("distinct_count").between(*DIVERSE_VALUES)).orderBy(
        F.desc("distinct_count"), order).limit(1)


def _columns_of(df: DataFrame, schema: dict[str, str], *types: str) -> list[str]:
    return [c for c in df.columns if schema.get(c) in types]


def kpis(df: DataFrame, schema: dict[str, str], filters: dict | None = None, search: str = "") -> DataFrame:
    """(seq, kpi, column, label, value): row count, sum and mean of the first number, top category."""
    rows = search_text(apply_filters(df, filters or {}), search, schema)
    nums, texts = _columns_of(df, schema, "NUM"), _columns_of(df, schema, "TEXT")
    entry = lambda seq, kpi, column, val: F.struct(
        F.lit(seq).alias("seq"), F.lit(kpi).alias("kpi"), F.lit(column).cast("string").alias("column"),
        F.lit(None).cast("string").alias("label"), val.cast("double").alias("value"))
    entries, aggregates = [entry(1, "total_records", None, F.col("n"))], [F.count("*").alias("n")]
    if nums:
        aggregates += [F.sum(number(df, nums[0])).alias("s"), F.avg(number(df, nums[0])).alias("a")]
        entries += [entry(2, "sum_value", nums[0], F.round(F.coalesce("s", F.lit(0.0)), 2)),
                    entry(3, "avg_value", nums[0], F.round(F.coalesce("a", F.lit(0.0)), 2))]
    result = rows.agg(*aggregates).select(F.inline(F.array(*entries)))
    if nums and texts:
        top = _sums(rows, texts[0], nums[0]).orderBy(F.desc_nulls_last("value"), F.asc_nulls_first("key")).limit(1)
        result = result.unionByName(top.select(
            F.lit(4).alias("seq"), F.lit("top_category").alias("kpi"), F.lit(texts[0]).alias("column"),
            F.col("key").cast("string").alias("label"), F.round("value", 2).alias("value")))
    return result


def _sums(df: DataFrame, name: str, metric: str | None) -> DataFrame:
    """(key, value) per group; the key keeps its own type, so dates and numbers sort as such."""
    total = F.sum(number(df, metric)) if metric else F.count("*").cast("double")
    return df.groupBy(value(df, name).alias("key")).agg(total.alias("value"))


def _shown(frame: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("key").cast("string"), F.lit("Null"))
    return frame.select(label.alias("label"), F.coalesce("value", F.lit(0.0)).alias("value"))


def series(df: DataFrame, schema: dict[str, str], metric: str | None, dimension: str | None,
           filters: dict | None = None, kind: str = "bar") -> DataFrame:
    """(label, value): metric sum (or row count) per dimension value, every row in one of at most 15 points.

    Dates are gathered into days, weeks, months, years or more until they fit. Other columns show
    their largest values and the sum of the rest as "Others"; a line goes by label. A missing dimension
    falls back to the first date, then the first text, then any column other than the metric.
    """
    metric = resolve_name(metric, df.columns) if metric else None
    found = resolve_name(dimension, df.columns) if dimension and dimension != "none" else None
    if not found:
        dates, texts = _columns_of(df, schema, "DATE"), _columns_of(df, schema, "TEXT", "MIXED")
        others = [c for c in df.columns if c != metric] or df.columns
        found, kind = (dates[0], "line") if dates else (texts[0], "bar") if texts else (others[0], kind)
    rows = apply_filters(df, filters or {})
    if schema.get(found) == "DATE":
        return _shown(_by_time(rows, found, metric, SERIES_POINTS))
    order = [F.asc_nulls_first("key")] if kind == "line" else [F.desc_nulls_last("value"), F.asc_nulls_first("key")]
    return _with_others(_sums(rows, found, metric), order, SERIES_POINTS)


def _with_others(sums: DataFrame, order: list[Column], points: int) -> DataFrame:
    """(label, value): the first groups, and the sum of all others as one more when there are any."""
    top = sums.orderBy(*order).limit(points + 1)
    known = top.collect()
    listed = _shown(literal_rows(sums, known[:points], top.schema))
    if len(known) <= points:
        return listed
    keys = [r["key"] for r in known[:points]]
    inside = F.coalesce(F.col("key").isin([k for k in keys if k is not None]), F.lit(None in keys))
    return listed.unionByName(sums.where(~inside).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(
        F.lit("Others").alias("label"), "value"))


UNITS = (("day", "yyyy-MM-dd"), ("week", "yyyy-MM-dd"), ("month", "yyyy-MM"), ("year", "yyyy"))
YEARS = (5, 10, 25, 50, 100, 1000)


def _by_time(rows: DataFrame, date: str, metric: str | None, points: int) -> DataFrame:
    """(key, value) per date, or per the first of day, week, month, year and 5 to 1,000 years that has few enough groups.

    A group's key is its first day, shown as far as the unit goes. All rows are in the groups, NULL dates in one of their own.
    Rows are summed by day once; all larger units come from the days.
    """
    sums = _sums(rows, date, metric).withColumn("key", F.col("key").cast("string"))
    known = sums.limit(points + 1).collect()
    if len(known) <= points:
        return literal_rows(rows, known, sums.schema).orderBy(F.asc_nulls_first("key"))
    total = F.sum(number(rows, metric)) if metric else F.count("*").cast("double")
    days = rows.groupBy(F.date_trunc("day", dated(rows, date)).alias("day")).agg(total.alias("value"))
    keys = [F.date_format(F.date_trunc(unit, "day"), shape) for unit, shape in UNITS]
    keys += [F.lpad((F.floor(F.year("day") / n) * n).cast("string"), 4, "0") for n in YEARS]
    units = days.select(F.posexplode(F.array(*keys)).alias("unit", "key"), "value").groupBy("unit", "key").agg(F.sum("value").alias("value"))
    counted = units.withColumn("n", F.count("*").over(W.partitionBy("unit")))
    fitting = counted.where((F.col("n") <= points) | (F.col("unit") == len(keys) - 1)).collect()
    unit = min(r["unit"] for r in fitting)
    chosen = [(r["key"], r["value"]) for r in fitting if r["unit"] == unit]
    return literal_rows(rows, chosen, "key string, value double").orderBy(F.asc_nulls_first("key"))


def share_by_category(df: DataFrame, name: str, metric: str, filters: dict | None = None) -> DataFrame:
    """(kind, label, value): all groups as a pie up to 6, else the 10 largest and "Others" as bars.

    The eleven largest groups are fetched; only if there are more than ten, one more aggregate
    sums the rows of all the others.
    """
    rows = apply_filters(df, filters or {})
    top = _sums(rows, name, metric).orderBy(F.desc_nulls_last("value"), F.asc_nulls_first("key")).limit(BAR_SLICES + 1)
    known = top.collect()
    kind = F.lit("pie" if len(known) <= PIE_SLICES else "bar").alias("kind")
    named = literal_rows(df, known[:BAR_SLICES] if len(known) > 1 else [], top.schema)
    shares = _shown(named).select(kind, "label", "value")
    if len(known) <= BAR_SLICES:
        return shares
    keys = [r["key"] for r in known[:BAR_SLICES]]
    listed = value(df, name).isin([k for k in keys if k is not None])
    listed = F.coalesce(listed, F.lit(None in keys))      # NULL is a group like any other
    others = rows.where(~listed).agg(F.coalesce(F.sum(number(df, metric)), F.lit(0.0)).alias("value"))
    return shares.unionByName(others.select(kind, F.lit("Others").alias("label"), "value"))


def frequency_by_category(df: DataFrame, name: str, limit: int = SERIES_POINTS, filters: dict | None = None) -> DataFrame:
    """(label, count) of the most frequent values, and of all others as "Others"; NULL shows as "Missing"."""
    counts = apply_filters(df, filters or {}).groupBy(F.coalesce(value(df, name).cast("string"), F.lit("Missing")).alias("key")).agg(
        F.count("*").alias("value"))
    return _with_others(counts, [F.desc("value"), F.asc("key")], limit).select("label", F.col("value").cast("bigint").alias("count"))


def timeline(df: DataFrame, date: str, metric: str, limit: int = TIMELINE_POINTS, filters: dict | None = None) -> DataFrame:
    """(label, value): metric sum per date, or per day, week, month or year where those are too many; needs more than one."""
    points = _by_time(apply_filters(df, filters or {}), date, metric, limit)
    return _shown(points if points.count() > 1 else points.limit(0))


def stacked_matrix(df: DataFrame, date: str, category: str, metric: str, filters: dict | None = None) -> DataFrame:
    """Date by category matrix of sums, one column per category; only for 2 to 5 categories."""
    rows = apply_filters(df, filters or {}).select(
        F.coalesce(as_label(df, date), F.lit("Null")).alias("date"), as_label(df, category).alias("category"),
        number(df, metric).alias("v"))
    found = [r["category"] for r in rows.select("category").distinct().limit(7).collect()]
    known = sorted(c for c in found if c is not None)
    if not 2 <= len(known) <= 5:
        return empty_like(df, "date string")
    names = known + (["Null"] if None in found else [])
    rows = rows.withColumn("category", F.coalesce("category", F.lit("Null")))
    enough = rows.groupBy("date", "category").agg(F.count("*")).limit(5).agg(F.count("*") > 4).scalar()
    return rows.groupBy("date").pivot("category", names).agg(F.sum("v")).na.fill(0.0).where(enough)


def recommend_charts(df: DataFrame, schema: dict[str, str], filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """(idx, type, x_column, y_column): the charts whose data is large enough, or the first ``limit`` of them.

    Sizes are asked up to the largest that makes a difference only: a few distinct values of each column.
    """
    nums, texts, dates = (_columns_of(df, schema, *t) for t in (("NUM",), ("TEXT", "MIXED"), ("DATE",)))
    rows = apply_filters(df, filters or {})
    sized = dict.fromkeys(dates[:1] + texts)

    def few(name: str, most: int, *cs: str) -> DataFrame:
        """How many distinct values there are, up to ``most``: NULL is one too."""
        return rows.select(*[value(df, c).alias(f"c{i}") for i, c in enumerate(cs)]).distinct().limit(most).agg(
            F.count("*").alias("n"), F.count("c0").alias("filled")).select(F.lit(name).alias("of"), "n", "filled")

    asked = [few(f"g{i}", PIE_SLICES + 1, c) for i, c in enumerate(sized)]
    if texts:
        asked.append(few("stack", 7, texts[0]))
    if dates and texts:
        asked.append(few("cells", 5, dates[0], texts[0]))
    asked.append(rows.limit(6).agg(F.count("*").alias("n"), F.count("*").alias("filled")).select(F.lit("rows").alias("of"), "n", "filled"))
    facts = {r["of"]: r for r in union_all(asked).collect()}
    size = {c: facts[f"g{i}"]["n"] for i, c in enumerate(sized)}
    charts = []
    if dates and nums and size[dates[0]] > 1:
        charts.append(("line", dates[0], nums[0]))
    for c in texts:
        if size[c] > 1:
            kind = "bar" if not nums or size[c] > PIE_SLICES else "pie"
            charts.append((kind, c, nums[0] if nums else "count"))
    if len(nums) >= 2 and facts["rows"]["n"] > 5:
        charts.append(("scatter", nums[0], nums[1]))
    if dates and texts and nums and 2 <= facts["stack"]["filled"] <= 5 and facts["cells"]["n"] > 4:
        charts.append(("area", dates[0], nums[0]))
    return literal_rows(df, [(i, *c) for i, c in enumerate(charts if limit is None else charts[:limit], 1)],
                        "idx int, type string, x_column string, y_column string")


def chart_data(df: DataFrame, schema: dict[str, str], charts: DataFrame, key: list[str],
               filters: dict | None = None) -> dict[int, DataFrame]:
    """The data of each recommended chart (one row per chart is read to know which)."""
    rows = apply_filters(df, filters or {})
    texts = _columns_of(df, schema, "TEXT", "MIXED")
    build = {
        "line": lambda x, y: timeline(rows, x, y),
        "scatter": lambda x, y: scatter_points(rows, x, y, key),
        "area": lambda x, y: stacked_matrix(rows, x, texts[0], y),
    }
    by_category = lambda x, y: frequency_by_category(rows, x) if y == "count" else share_by_category(rows, x, y)
    return {r["idx"]: build.get(r["type"], by_category)(r["x_column"], r["y_column"]) for r in charts.collect()}


def dashboard(df: DataFrame, schema: dict[str, str], key: list[str], filters: dict | None = None, search: str = "",
              sort: str | None = None, direction: str = "ASC", page_number: int = 1, size: int = 20) -> dict:
    """KPIs, charts, findings and a table page. Charts and findings ignore the search text."""
    from tabulight.operators.findings import dashboard_findings

    table, total = drill_table(df, schema, filters, search, sort, direction, page_number, size, key)
    charts = recommend_charts(df, schema, filters)
    return {
        "kpis": kpis(df, schema, filters, search), "charts": charts,
        "chart_data": chart_data(df, schema, charts, key, filters),
        "findings": dashboard_findings(df, schema, filters), "table": table, "total": total,
    }
