"""Monthly series and trends. After grouping by month a series is a few hundred rows at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabulight.functions.columns import number, number_sql, text_sql
from tabulight.plans.dates import dated, dated_sql
from tabulight.plans.profile import empty_like, inline_sql, struct_sql, union_all
from tabulight.plans.ranking import with_position

EMPTY_MONTHS = "date_column string, metric string, month string, mean double, sum double, count bigint"


def _whole():
    return W.partitionBy("date_column", "metric")


def _series():
    return _whole().orderBy("month")


def monthly_means(df: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    """(date_column, metric, month, mean, sum, count): all metrics of a date column in one scan."""
    if not metrics:
        return empty_like(df, EMPTY_MONTHS)
    wide = (
        df.selectExpr(f"date_format({dated_sql(df, date)}, 'yyyy-MM') as month",
                      *[f"{number_sql(df, m)} as v{i}" for i, m in enumerate(metrics)])
        .where("month is not null").groupBy("month")
        .agg(*[F.expr(f"{f}(v{i}) as {f}{i}") for i in range(len(metrics)) for f in ("avg", "sum", "count")])
    )
    rows = inline_sql([
        struct_sql(date_column=text_sql(date), metric=text_sql(m), month="month", mean=f"avg{i}", sum=f"sum{i}", count=f"count{i}")
        for i, m in enumerate(metrics)])
    return wide.selectExpr(rows).where("count > 0")


def monthly(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(month, mean, sum, count) in month order."""
    return monthly_means(df, date, [metric]).select("month", "mean", "sum", "count").orderBy("month")


def _trends(months: DataFrame) -> DataFrame:
    indexed = months.withColumn("i", F.row_number().over(_series()) - 1)
    half = F.floor(F.col("periods") / 2)
    slope = F.coalesce(F.regr_slope("mean", "i"), F.lit(0.0))
    early = F.avg(F.when(F.col("i") < half, F.col("mean")))
    late = F.avg(F.when(F.col("i") >= half, F.col("mean")))
    return (
        indexed.withColumn("periods", F.count("*").over(_whole()))
        .groupBy("date_column", "metric", "periods")
        .agg(slope.alias("slope"), F.sum("count").alias("rows"), early.alias("early"), late.alias("late"))
        .where("rows >= 15 AND periods >= 3")
        .select(
            "date_column", "metric",
            F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction"),
            F.when(F.abs("slope") > 1, "strong").when(F.abs("slope") > 0.1, "moderate").otherwise("slight").alias("strength"),
            F.round("slope", 6).alias("slope"), F.col("periods").cast("bigint").alias("periods"),
            F.when(F.col("periods") < 6, None)
            .when(F.col("late") > F.col("early") * 1.1, "accelerating")
            .when(F.col("early") > F.col("late") * 1.1, "decelerating").alias("half_shift"),
        )
    )


def trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Direction and strength of the monthly mean; needs 15 rows and 3 months."""
    return _trends(monthly_means(df, date, [metric])).drop("half_shift")


def half_shift(df: DataFrame, date: str, metric: str) -> DataFrame:
    """accelerating / decelerating by comparing the later with the earlier half of 6+ months."""
    return _trends(monthly_means(df, date, [metric])).where("half_shift is not null").select(
        "date_column", "metric", "half_shift")


def _changes(months: DataFrame, last: int | None) -> DataFrame:
    previous = F.lag("mean").over(_series())
    change = F.when(previous == 0, 0.0).otherwise(
        F.round(F.try_divide(100 * (F.col("mean") - previous), F.abs(previous)), 2))
    from_end = F.row_number().over(_whole().orderBy(F.desc("month")))
    rows = (
        months.withColumn("change_pct", change).withColumn("from_end", from_end)
        .where("change_pct is not null")
    )
    if last:
        rows = rows.where(F.col("from_end") <= last)
    sign = F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat")
    return rows.select("date_column", "metric", F.col("month").alias("period"), "change_pct",
                       sign.alias("direction"), "from_end")


def mom_changes(df: DataFrame, date: str, metric: str, last: int | None = 6) -> DataFrame:
    """Change of the monthly mean against the previous month that has data."""
    return _changes(monthly_means(df, date, [metric]), last).drop("from_end")


def recent_change(df: DataFrame, date: str, metric: str) -> DataFrame:
    """The latest month when it changed by more than 20 %."""
    return _recent(_changes(monthly_means(df, date, [metric]), 1))


def _recent(changes: DataFrame) -> DataFrame:
    return changes.where("from_end = 1 AND abs(change_pct) > 20").drop("from_end")


def trend_by_date(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Trend of the sum per raw date value: slope over the date index and change first to last."""
    sums = (
        df.select(dated(df, date).alias("day"), number(df, metric).alias("v")).where("day is not null")
        .groupBy("day").agg(F.sum("v").alias("total")).where("total is not null")
    )
    day = F.col("day")
    micros = F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), F.current_timezone())).cast("double")
    first, last = F.min_by("total", "day"), F.max_by("total", "day")
    return (
        with_position(sums, "day", micros)
        .agg(F.count("*").alias("dates"), F.regr_slope("total", "position").alias("slope"),
             first.alias("first"), last.alias("last"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))
        .where("dates >= 4 AND first > 0")
        .select(
            F.lit(date).alias("date_column"), F.lit(metric).alias("metric"), "dates",
            F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction"),
            F.round(100 * (F.col("last") - F.col("first")) / F.col("first"), 1).alias("change_pct"),
            F.date_format("first_date", "yyyy-MM-dd").alias("first_date"),
            F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
        )
    )


def all_months(df: DataFrame, dates: list[str], metrics: list[str]) -> DataFrame:
    """Monthly rows of every date and numeric column."""
    frames = [monthly_means(df, d, metrics) for d in dates]
    return union_all(frames) if frames else empty_like(df, EMPTY_MONTHS)


def trend_report(df: DataFrame, dates: list[str], metrics: list[str], months: DataFrame | None = None) -> DataFrame:
    """One row per (date, metric): trend, half shift and the latest monthly change."""
    months = all_months(df, dates, metrics) if months is None else months
    latest = _changes(months, 1).select(
        "date_column", "metric", F.col("period").alias("last_period"), F.col("change_pct").alias("last_change_pct"))
    return _trends(months).join(latest, ["date_column", "metric"], "left")


def trend_counts(report: DataFrame) -> DataFrame:
    """(growth, decline) numbers of upward and downward trends."""
    return report.agg(
        F.count(F.when(F.col("direction") == "upward", 1)).alias("growth"),
        F.count(F.when(F.col("direction") == "downward", 1)).alias("decline"))
