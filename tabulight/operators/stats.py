"""Statistics of numeric columns: summaries, outliers, correlation, anomalies.

Column-level constants (means, quartiles) are read first as one row and then used as
literals, so the second scan is a plain filter or conditional count.
"""

from __future__ import annotations

from itertools import combinations
from math import isfinite

from pyspark.sql import DataFrame, Window as W, functions as F

from tabulight.functions import vocab
from tabulight.functions.columns import (
    double_sql, number, number_sql, percent, severity, text_sql,
)
from tabulight.operators.timeseries import monthly_means
from tabulight.plans.gram import pair_sums
from tabulight.plans.profile import (
    column_modes, column_profile, empty_like, inline_sql, literal_rows, struct_sql, union_all,
)
from tabulight.plans.quantiles import quantiles

ANOMALY_SCHEMA = "column string, type string, severity string, value double, pct double"
#: Pairs of eight columns, each with itself too; the generated code of more would be too large.
AGGREGATED_PAIRS = 36
#: Columns whose moments one aggregate asks for; the generated code of more is too long for the JVM to optimise.
MOMENT_COLUMNS = 5


def numbers(df: DataFrame):
    """Column name to the SQL of its numeric value."""
    return lambda c: number_sql(df, c)


def quartiles(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, list[float | None]]:
    """q1, median and q3 per column; exact unless ``approx``."""
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.expr(f"percentile_approx({number_sql(df, c)}, array(0.25, 0.5, 0.75)) as q{i}")
                       for i, c in enumerate(columns)]).first()
        return {c: list(row[i]) if row[i] else [None] * 3 for i, c in enumerate(columns)}
    return quantiles(df, columns, [0.25, 0.5, 0.75], numbers(df))


def stat_summary(df: DataFrame, columns: list[str], limit: int | None = None, approx: bool = False,
                 quarts: dict | None = None) -> DataFrame:
    """One row per numeric column: moments, quartiles, mode and two shape labels."""
    columns = columns[:limit]
    v = numbers(df)
    quarts = quarts or quartiles(df, columns, approx)
    moments = column_profile(df, columns, {
        "count": ("bigint", lambda c: f"count({v(c)})"),
        "mean": ("double", lambda c: f"avg({v(c)})"),
        "std": ("double", lambda c: f"stddev_samp({v(c)})"),
        "variance": ("double", lambda c: f"var_samp({v(c)})"),
        "min": ("double", lambda c: f"min({v(c)})"),
        "max": ("double", lambda c: f"max({v(c)})"),
    }, MOMENT_COLUMNS)
    quarter_rows = literal_rows(
        df, [(c, *quarts[c]) for c in columns], "column string, q1 double, median double, q3 double"
    )
    modes = column_modes(df, columns, v) if columns else empty_like(df, "column string, mode double")
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide("std", "mean"))
    r4 = lambda name: F.round(name, 4).alias(name)
    return (
        moments.join(F.broadcast(quarter_rows), "column").join(F.broadcast(modes), "column")
        .where("count > 0")
        .select(
            "column", "position", "count", r4("mean"), r4("median"), r4("mode"), r4("std"), r4("variance"),
            r4("min"), r4("max"), r4("q1"), r4("q3"), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
            F.when(F.col("mean") > F.col("median"), "Right-skewed (positive skew)")
            .when(F.col("mean") < F.col("median"), "Left-skewed (negative skew)").otherwise("Normal").alias("skewness"),
            F.when(cv > 0.5, "High").when(cv > 0.2, "Medium").otherwise("Low").alias("variability"),
        )
    )


def notable_stats(summary: DataFrame) -> DataFrame:
    """(column, note): high variability, and mean away from the median."""
    high = summary.where("variability = 'High'").select("column", F.lit("high variability").alias("note"))
    return high.unionByName(
        summary.where("skewness LIKE '%skew%'").select("column", F.col("skewness").alias("note"))
    )


def _bounds(q: list[float | None]) -> tuple[str, str]:
    """Outlier limits as literals; NULL limits (no numbers) match nothing."""
    if q[0] is None:
        return double_sql(None), double_sql(None)
    iqr = q[2] - q[0]
    return double_sql(q[0] - 1.5 * iqr), double_sql(q[2] + 1.5 * iqr)


def iqr_outliers(df: DataFrame, columns: list[str], min_count: int = 10, skip_zero_iqr: bool = False,
                 quarts: dict | None = None) -> DataFrame:
    """Counts outside q1 - 1.5 iqr and q3 + 1.5 iqr; only columns that have any."""
    v = numbers(df)
    quarts = quarts or quartiles(df, columns)
    limits = {c: _bounds(quarts[c]) for c in columns}
    outside = lambda c: f"case when {v(c)} < {limits[c][0]} or {v(c)} > {limits[c][1]} then {v(c)} end"
    counted = column_profile(df, columns, {
        "count": ("bigint", lambda c: f"count({v(c)})"),
        "low_outliers": ("bigint", lambda c: f"count_if({v(c)} < {limits[c][0]})"),
        "high_outliers": ("bigint", lambda c: f"count_if({v(c)} > {limits[c][1]})"),
        "min_outlier": ("double", lambda c: f"min({outside(c)})"),
        "max_outlier": ("double", lambda c: f"max({outside(c)})"),
    })
    quarter_rows = literal_rows(
        df, [(c, quarts[c][0], quarts[c][2]) for c in columns], "column string, q1 double, q3 double"
    )
    iqr, total = F.col("q3") - F.col("q1"), F.col("low_outliers") + F.col("high_outliers")
    rows = counted.join(F.broadcast(quarter_rows), "column").where((F.col("count") >= min_count) & (total > 0))
    if skip_zero_iqr:
        rows = rows.where(iqr != 0)
    pct = percent(total, F.col("count"))
    return rows.select(
        "column", "position", "low_outliers", "high_outliers", total.alias("total_outliers"), pct.alias("outlier_pct"),
        F.round(F.col("q1") - 1.5 * iqr, 4).alias("low_threshold"),
        F.round(F.col("q3") + 1.5 * iqr, 4).alias("high_threshold"),
        F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), F.round(iqr, 4).alias("iqr"),
        "min_outlier", "max_outlier", severity(pct, 10, 5).alias("severity"),
    )


def iqr_outliers_basic(df: DataFrame, columns: list[str], quarts: dict | None = None) -> DataFrame:
    """(column, outliers) the way the overview counts: 4 values are enough, a zero iqr is not."""
    return iqr_outliers(df, columns, 4, True, quarts).select("column", F.col("total_outliers").alias("outliers"))


def outlier_bounds(df: DataFrame, columns: list[str], quarts: dict | None = None) -> DataFrame:
    """Limits, count and extreme outliers of columns with more than 5 values."""
    return iqr_outliers(df, columns, 6, False, quarts).select(
        "column", "q1", "q3", "iqr", F.col("low_threshold").alias("lower_threshold"),
        F.col("high_threshold").alias("upper_threshold"), F.col("total_outliers").alias("outliers_count"),
        "min_outlier", "max_outlier",
    )


def outlier_rows(df: DataFrame, name: str, quarts: dict | None = None) -> DataFrame:
    """The rows whose value lies outside the limits."""
    low, high = _bounds((quarts or quartiles(df, [name]))[name])
    return df.where(f"{number_sql(df, name)} < {low} or {number_sql(df, name)} > {high}")


def _centred_pairs(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(var1, var2, r): values are shifted by their column mean, then multiplied and summed.

    Shifting keeps the sums small. For a few pairs one scan finds the means and one more all sums; beyond, one scan
    multiplies matrices. A pair with NULLs gets its own sums over the rows where
    both values exist. Constant columns and those with infinite values have no r.
    """
    v = numbers(df)
    if len(pairs) > AGGREGATED_PAIRS:
        return _multiplied_pairs(df.selectExpr(*[f"{v(c)} as d{i}" for i, c in enumerate(columns)]), columns, pairs)
    facts = df.agg(F.count("*").alias("n"), *[
        F.expr(f"{f.format(v(c))} as {k}{i}") for i, c in enumerate(columns)
        for k, f in (("m", "avg({})"), ("c", "count({})"), ("e", "min({0}) = max({0})"))
    ]).first()
    if not facts["n"]:
        return literal_rows(df, [(a, b, None) for a, b in pairs], "var1 string, var2 string, r double")
    endless = {c for i, c in enumerate(columns) if not isfinite(facts[f"m{i}"] or 0.0)}
    unknown = endless | {c for i, c in enumerate(columns) if facts[f"e{i}"]}
    shifted = df.selectExpr(*[
        f"double(null) as d{i}" if c in endless else f"{v(c)} - {double_sql(facts[f'm{i}'] or 0.0)} as d{i}"
        for i, c in enumerate(columns)])
    full = {c for i, c in enumerate(columns) if facts[f"c{i}"] == facts["n"]}
    return _aggregated_pairs(shifted, columns, pairs, unknown, full)


def _multiplied_pairs(values: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    place = {c: i for i, c in enumerate(columns)}
    names = f"array({', '.join(text_sql(c) for c in columns)})"
    varies = " and ".join(f"l{v} < h{v} and l{v} > double('-inf') and h{v} < double('inf') and {v * 2} > 0" for v in "xy")
    r = "xy / (sqrt(xx) * sqrt(yy))"
    return pair_sums(values, [(place[a], place[b]) for a, b in pairs]).selectExpr(
        f"{names}[a] as var1", f"{names}[b] as var2", f"case when {varies} then round(greatest(-1D, least(1D, nanvl({r}, null))), 4) end as r")


def _pearson_sql(n: str, sx: str, sy: str, xx: str, yy: str, xy: str) -> str:
    cross = f"({xy} - try_divide({sx} * {sy}, {n}))"
    spread = " * ".join(f"sqrt(greatest({square} - try_divide({s} * {s}, {n}), 0))" for square, s in ((xx, sx), (yy, sy)))
    return f"case when {spread} > 0 then round(greatest(-1D, least(1D, {cross} / ({spread}))), 4) end"


def _aggregated_pairs(
    shifted: DataFrame, columns: list[str], pairs: list[tuple[str, str]], unknown: set[str], full: set[str],
) -> DataFrame:
    at = {c: f"d{i}" for i, c in enumerate(columns)}
    sums: dict[str, str] = {}       # aggregate SQL -> its name, so equal sums are asked once

    def total(e: str) -> str:
        return sums.setdefault(f"sum({e})", f"t{len(sums)}")

    rows = []
    for a, b in pairs:
        x, y, n = at[a], at[b], "1"
        if not (a in full and b in full):
            x, y = f"case when {at[b]} is not null then {at[a]} end", f"case when {at[a]} is not null then {at[b]} end"
            n = f"if({at[a]} is null or {at[b]} is null, 0, 1)"
        r = _pearson_sql(total(n), total(x), total(y), total(f"({x}) * ({x})"), total(f"({y}) * ({y})"), total(f"{at[a]} * {at[b]}"))
        rows.append(struct_sql(var1=text_sql(a), var2=text_sql(b), r="double(null)" if {a, b} & unknown else r))
    return shifted.agg(*[F.expr(f"{e} as {name}") for e, name in sums.items()]).selectExpr(inline_sql(rows))


def correlation_matrix(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """(var1, var2, r) for all ordered pairs, Pearson on rows where both exist; NULL if constant."""
    columns = columns[:limit]
    if not columns:
        return empty_like(df, "var1 string, var2 string, r double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = _centred_pairs(df, columns, pairs)
    mirrored = F.array_distinct(F.array(
        F.struct("var1", "var2", "r"),
        F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"),
    ))
    return upper.select(F.inline(mirrored))


def correlation_pairs(df: DataFrame, columns: list[str], limit: int | None = None, top: int | None = None) -> DataFrame:
    """(strength, rank, var1, var2, r): all strong positive, strong negative and weak pairs, or the ``top`` of each."""
    columns = columns[:limit]
    if len(columns) < 2:
        return empty_like(df, "strength string, rank int, var1 string, var2 string, r double")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("var1")) * len(columns) + \
        F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("var2"))
    r = F.col("r")
    labelled = _centred_pairs(df, columns, list(combinations(columns, 2))).withColumn(
        "strength", F.when(r >= 0.5, "strong positive").when(r <= -0.5, "strong negative").when(F.abs(r) < 0.2, "weak")
    ).where("strength is not null")
    by_size = F.when(F.col("strength") == "weak", 0.0).otherwise(-F.abs(r))
    rank = F.row_number().over(W.partitionBy("strength").orderBy(by_size, place))
    ranked = labelled.withColumn("rank", rank.cast("int")).select("strength", "rank", "var1", "var2", "r")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def strong_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of numeric columns with |r| of 0.70 or more."""
    if len(columns) < 2:
        return empty_like(df, "var1 string, var2 string, r double, strength string")
    return _centred_pairs(df, columns, list(combinations(columns, 2))).where(F.abs("r") >= 0.70).withColumn(
        "strength", F.when(F.col("r") > 0, "strong positive").otherwise("strong negative"))


def primary_metric(df: DataFrame, columns: list[str]) -> str | None:
    """First column named like a metric that has values, else the one with the largest variance (5+ values)."""
    if not columns:
        return None
    v = numbers(df)
    named = [c for c in columns if any(h in c.lower() for h in vocab.METRIC_HINTS)]
    if named:
        filled = df.agg(*[F.expr(f"count({v(c)}) > 0 as f{i}") for i, c in enumerate(named)]).first()
        named = [c for i, c in enumerate(named) if filled[f"f{i}"]]
    if named:
        return named[0]
    spread = column_profile(df, columns, {
        "n": ("bigint", lambda c: f"count({v(c)})"),
        "variance": ("double", lambda c: f"var_samp({v(c)})"),
    }).where("n >= 5")
    best = spread.orderBy(F.desc("variance"), "position").limit(1).collect()
    return best[0]["column"] if best else columns[0]


def primary_metric_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return literal_rows(df, [(primary_metric(df, columns),)], "metric string")


def zscore_anomalies(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Columns with values more than three sample deviations from the mean."""
    columns = columns[:limit]
    v = numbers(df)
    facts = {r["column"]: r for r in column_profile(df, columns, {
        "n": ("bigint", lambda c: f"count({v(c)})"), "mean": ("double", lambda c: f"avg({v(c)})"),
        "std": ("double", lambda c: f"stddev_samp({v(c)})"),
    }).collect()}
    usable = [c for c in columns if facts[c]["n"] >= 15 and facts[c]["std"]]
    far = lambda c: f"abs({v(c)} - {double_sql(facts[c]['mean'])}) / {double_sql(facts[c]['std'])} > 3"
    counted = column_profile(df, usable, {
        "n": ("bigint", lambda c: f"count({v(c)})"), "far": ("bigint", lambda c: f"count_if({far(c)})"),
    })
    pct = percent(F.col("far"), F.col("n"))
    return counted.where(pct > 0).select(
        "column", F.lit("extreme_value").alias("type"), severity(pct, 5, 2).alias("severity"),
        F.col("far").cast("double").alias("value"), pct.alias("pct"),
    )


def period_spikes(df: DataFrame, date: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Months whose mean is more than 50 % away from the mean of all monthly means."""
    means = monthly_means(df, date, columns[:limit])
    metric = W.partitionBy("metric")      # a few rows per metric: one for each month
    overall = F.avg("mean").over(metric)
    gap = F.try_divide(F.col("mean") - overall, F.abs(overall))
    return (
        means.select(
            "metric", "month", "mean", gap.alias("gap"),
            F.count("*").over(metric).alias("months"), F.sum("count").over(metric).alias("rows"),
        )
        .where("rows >= 20 AND months >= 4 AND abs(gap) > 0.5")
        .select(
            F.col("metric").alias("column"), "month",
            F.when(F.col("gap") > 0, "spike_detected").otherwise("drop_detected").alias("type"),
            F.when(F.abs("gap") > 1.0, "HIGH").otherwise("MEDIUM").alias("severity"),
            F.round("mean", 4).alias("value"), F.round(F.col("gap") * 100, 2).alias("pct"),
        )
    )


def _sign_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    v = numbers(df)
    return column_profile(df, columns, {
        "rows": ("bigint", lambda c: "count(*)"),
        "zeros": ("bigint", lambda c: f"count_if({v(c)} = 0)"),
        "negatives": ("bigint", lambda c: f"count_if({v(c)} < 0)"),
    })


def excess_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns where more than half of all rows are zero."""
    return _sign_counts(df, columns).where("zeros > rows * 0.5").select(
        "column", F.lit("excessive_zeros").alias("type"), F.lit("MEDIUM").alias("severity"),
        F.col("zeros").cast("double").alias("value"), percent(F.col("zeros"), F.col("rows")).alias("pct"),
    )


def negative_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with more than 1 % negative rows, unless the name says it may be negative."""
    pct = percent(F.col("negatives"), F.col("rows"))
    return (
        _sign_counts(df, columns)
        .where(~F.lower("column").isin(vocab.SIGNED_NAMES) & (pct > 1))
        .select("column", F.lit("negative_values").alias("type"), F.lit("LOW").alias("severity"),
                F.col("negatives").cast("double").alias("value"), pct.alias("pct"))
    )


def anomalies(df: DataFrame, numeric: list[str], dates: list[str], outliers: DataFrame | None = None) -> DataFrame:
    """(column, type, severity, value, pct) from all anomaly rules."""
    outliers = iqr_outliers(df, numeric) if outliers is None else outliers
    parts = [zscore_anomalies(df, numeric), excess_zeros(df, numeric), negative_share(df, numeric)]
    if dates and numeric:
        parts.append(period_spikes(df, dates[0], numeric).drop("month"))
    parts.append(outliers.where("severity = 'HIGH'").select(
        "column", F.lit("high_severity_outliers").alias("type"), "severity",
        F.col("total_outliers").cast("double").alias("value"), F.col("outlier_pct").alias("pct")))
    return union_all(parts)


def skewed_metric(df: DataFrame, metric: str, quarts: dict | None = None) -> DataFrame:
    """(metric, mean, median) when they differ by more than 30 % of the mean; else empty."""
    median = (quarts or quartiles(df, [metric]))[metric][1]
    return df.agg(F.avg(number(df, metric)).alias("mean")).select(
        F.lit(metric).alias("metric"), F.round("mean", 4).alias("mean"),
        F.round(F.lit(median).cast("double"), 4).alias("median"),
        F.try_divide(F.abs(F.col("mean") - F.lit(median)), F.abs("mean")).alias("gap"),
    ).where("gap > 0.3").drop("gap")
