"""Findings: rules over the aggregates of all other operators. Results are codes and numbers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulight.functions import vocab
from tabulight.functions.columns import col, is_missing, number, percent
from tabulight.operators import quality, rows, segments, stats, timeseries
from tabulight.operators.filters import apply_filters
from tabulight.operators.schema import column_classes
from tabulight.plans.profile import empty_like, fetched, literal_rows, union_all

FINDING = "type string, subject string, priority string, v1 double, v2 double"
ADVICE = "area string, subject string, priority string"


def _finding(frame: DataFrame, kind: str | Column, subject: str | Column, priority: str | Column, v1=None, v2=None) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return frame.select(
        as_col(kind).alias("type"), as_col(subject).cast("string").alias("subject"), as_col(priority).alias("priority"),
        as_col(v1).cast("double").alias("v1"), as_col(v2).cast("double").alias("v2"))


class Analysis:
    """Shared intermediate results of one report on one table.

    Every section needs some of the same small frames (a few rows per column or month). Each is
    computed once and its rows are fetched. The table itself is never cached: an aggregate reads
    only its own columns.
    """

    def __init__(self, df: DataFrame, classes: dict[str, list[str]] | None = None):
        self.df = df
        self.classes = classes or column_classes(df)
        self.numeric, self.dates, self.categories = (self.classes[k] for k in ("numeric", "date", "categorical"))

    @cached_property
    def metric(self) -> str | None:
        return stats.primary_metric(self.df, self.numeric)

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        return stats.quartiles(self.df, self.numeric)

    @cached_property
    def statistics(self) -> DataFrame:
        return fetched(stats.stat_summary(self.df, self.numeric, quarts=self.quartiles))

    @cached_property
    def outliers(self) -> DataFrame:
        return fetched(stats.iqr_outliers(self.df, self.numeric, quarts=self.quartiles))

    @cached_property
    def correlations(self) -> DataFrame:
        return fetched(stats.correlation_pairs(self.df, self.numeric))

    @cached_property
    def months(self) -> DataFrame:
        return fetched(timeseries.all_months(self.df, self.dates, self.numeric))

    @cached_property
    def trends(self) -> DataFrame:
        return fetched(timeseries.trend_report(self.df, self.dates, self.numeric, self.months))

    @cached_property
    def category_table(self) -> DataFrame:
        return segments.category_table(self.df, self.categories, self.metric)

    @cached_property
    def segment_extremes(self) -> DataFrame:
        return fetched(segments.segment_extremes(self.df, self.categories, self.metric))

    @cached_property
    def anomalies(self) -> DataFrame:
        return fetched(stats.anomalies(self.df, self.numeric, self.dates, self.outliers))

    @cached_property
    def missing(self) -> DataFrame:
        return fetched(quality.missing_totals(self.df))

    @cached_property
    def duplicates(self) -> DataFrame:
        return fetched(quality.duplicate_count(self.df))

    # --- findings -----------------------------------------------------------------

    def concentrated(self) -> DataFrame:
        return segments._concentration(self.category_table).where("concentration = 'High'").orderBy("position")

    def insight_concentration(self) -> DataFrame:
        return _finding(self.concentrated(), "concentration_risk", F.col("column"), "HIGH", F.col("top_3_pct"), F.col("top_pct"))

    def insight_trends(self) -> DataFrame:
        kind = F.when(F.col("direction") == "upward", "growth_opportunity").otherwise("declining_trend")
        level = F.when(F.col("strength") == "strong", "HIGH").otherwise("MEDIUM")
        report = self.trends
        changed = report.where("abs(last_change_pct) > 20")
        return _finding(report, kind, F.col("metric"), level, F.col("slope")).unionByName(
            _finding(changed, "recent_change", F.col("metric"), "MEDIUM", F.col("last_change_pct")))

    def insight_performance_gap(self) -> DataFrame:
        if not (self.metric and self.categories):
            return empty_like(self.df, FINDING)
        gap = F.col("best_mean") - F.col("worst_mean")
        pct = F.coalesce(F.try_divide(100 * gap, "worst_mean"), F.lit(0.0))
        found = self.segment_extremes.where((F.col("segments") >= 2) & (gap > 0) & (pct > 10))
        return _finding(found, "performance_gap", F.col("column"), F.when(pct > 50, "HIGH").otherwise("MEDIUM"),
                        F.round(gap, 4), F.round(pct, 2))

    def insight_correlation(self) -> DataFrame:
        pair = F.concat_ws(" / ", "var1", "var2")
        up = self.correlations.where("strength = 'strong positive' AND rank <= 2")
        down = self.correlations.where("strength = 'strong negative' AND rank = 1")
        return _finding(up, "correlation_opportunity", pair, F.when(F.col("r") > 0.7, "HIGH").otherwise("MEDIUM"),
                        F.col("r")).unionByName(_finding(down, "tradeoff_insight", pair, "MEDIUM", F.col("r")))

    def insight_risk(self) -> DataFrame:
        high = lambda frame: frame.where("severity = 'HIGH'").agg(F.count("*").alias("n")).where("n > 0")
        parts = [
            _finding(high(self.outliers), "data_quality_risk", "outliers", "HIGH", F.col("n")),
            _finding(high(self.anomalies), "anomaly_alert", "anomalies", "HIGH", F.col("n")),
        ]
        if self.metric:
            gaps = self.df.agg(F.count(F.when(is_missing(self.df, self.metric), 1)).alias("n"), F.count("*").alias("rows"))
            parts.append(_finding(gaps.where("n > 0"), "missing_data_warning", self.metric, "MEDIUM", F.col("n"),
                                  percent(F.col("n"), F.col("rows"))))
            skew = stats.skewed_metric(self.df, self.metric, self.quartiles)
            parts.append(_finding(skew, "skewed_distribution", F.col("metric"), "MEDIUM", F.col("mean"), F.col("median")))
        if self.categories:
            diverse = segments.diverse_segment(
                quality.distinct_counts(self.df.select(*[col(c) for c in self.categories])), self.categories)
            parts.append(_finding(diverse, "segmentation_opportunity", F.col("column"), "MEDIUM", F.col("distinct_count")))
        return union_all(parts)

    @cached_property
    def insights(self) -> DataFrame:
        return fetched(union_all([
            self.insight_concentration(), self.insight_trends(), self.insight_performance_gap(),
            self.insight_correlation(), self.insight_risk()]))

    @cached_property
    def recommendations(self) -> DataFrame:
        advise = lambda frame, area, subject, level: frame.select(
            F.lit(area).alias("area"), subject.cast("string").alias("subject"),
            (level if isinstance(level, Column) else F.lit(level)).alias("priority"))
        strong = self.trends.where("strength IN ('strong', 'moderate')")
        parts = [
            advise(self.missing.where("null_cells > 0"), "Data Quality", F.lit("missing values"),
                   F.when(F.col("null_pct") > 5, "HIGH").otherwise("LOW")),
            advise(self.duplicates.where("duplicates > 0"), "Data Quality", F.lit("duplicate rows"),
                   F.when(F.col("severity") == "HIGH", "HIGH").otherwise("MEDIUM")),
            advise(strong.where("direction = 'downward'"), "Performance", F.col("metric"), "HIGH"),
            advise(strong.where("direction = 'upward'"), "Growth", F.col("metric"), "MEDIUM"),
            advise(self.concentrated(), "Risk Management", F.col("column"), "HIGH"),
            advise(self.outliers.where("severity = 'HIGH'").agg(F.count("*").alias("n")).where("n > 0"),
                   "Data Quality", F.lit("outliers"), "MEDIUM"),
            advise(self.insight_performance_gap().where("priority = 'HIGH'"), "Performance Improvement", F.col("subject"), "HIGH"),
        ]
        metric = self.metric or (self.numeric[0] if self.numeric else "")
        if self.numeric and self.categories:
            parts.append(literal_rows(self.df, [("Visualization", metric, "MEDIUM")], ADVICE))
        if len(self.numeric) >= 3:
            enough = self.df.agg(F.count("*").alias("n")).where("n >= 100")
            parts.append(advise(enough, "Advanced Analytics", F.lit(metric), "LOW"))
        found = union_all(parts)
        if self.numeric and self.categories:
            return found
        fallback = ("Analysis", self.metric, "MEDIUM") if self.metric else ("Exploration", "dataset", "LOW")
        none = found.agg(F.count("*") == 0).scalar()
        return found.unionByName(literal_rows(self.df, [fallback], ADVICE).where(none))

    @cached_property
    def theme(self) -> str:
        names = " ".join(c.lower() for c in self.df.columns)
        return next((t for t, words in vocab.THEMES.items() if any(w in names for w in words)), vocab.DEFAULT_THEME)

    @cached_property
    def summary(self) -> DataFrame:
        """(seq, topic, subject, value): the facts a manager reads first."""
        fact = lambda seq, topic, subject, v: F.struct(
            F.lit(seq).alias("seq"), F.lit(topic).alias("topic"), F.lit(subject).cast("string").alias("subject"),
            v.cast("double").alias("value"))
        shape = literal_rows(self.df, [
            (1, "theme", self.theme, None), (3, "columns", None, float(len(self.df.columns))),
            (4, "numeric columns", None, float(len(self.numeric))),
            (5, "categorical columns", None, float(len(self.categories))), (6, "date columns", None, float(len(self.dates))),
        ], "seq int, topic string, subject string, value double")
        counts = quality._one_row(
            self.missing, self.duplicates,
            timeseries.trend_counts(self.trends),
            self.outliers.agg(F.count("*").alias("outlier_columns"), F.count(F.when(F.col("severity") == "HIGH", 1)).alias("high_outliers")),
            self.anomalies.agg(F.count(F.when(F.col("severity") == "HIGH", 1)).alias("high_anomalies")),
            self.concentrated().agg(F.count("*").alias("concentrated")),
            self.insights.agg(F.count(F.when(F.col("priority") == "HIGH", 1)).alias("high_findings")))
        facts = [
            fact(2, "rows", None, F.col("rows")), fact(9, "missing cells", None, F.col("null_cells")),
            fact(10, "duplicate rows", None, F.col("duplicates")), fact(11, "upward trends", None, F.col("growth")),
            fact(12, "downward trends", None, F.col("decline")), fact(13, "outlier columns", None, F.col("outlier_columns")),
            fact(14, "high severity risks", None, F.col("high_outliers") + F.col("high_anomalies")),
            fact(15, "concentrated columns", None, F.col("concentrated")),
            fact(16, "high priority findings", None, F.col("high_findings")),
        ]
        parts = [shape, counts.select(F.inline(F.array(*facts)))]
        if self.metric:
            median = self.quartiles[self.metric][1]
            mean = self.df.agg(F.round(F.avg(number(self.df, self.metric)), 4).alias("mean"))
            parts.append(mean.select(F.inline(F.array(
                fact(7, "metric mean", self.metric, F.col("mean")),
                fact(8, "metric median", self.metric, F.round(F.lit(median).cast("double"), 4))))))
        return union_all(parts)


def insight_concentration(df: DataFrame, categories: list[str]) -> DataFrame:
    return Analysis(df, {"numeric": [], "date": [], "categorical": categories}).insight_concentration()


def insight_trends(df: DataFrame, dates: list[str], numeric: list[str]) -> DataFrame:
    return Analysis(df, {"numeric": numeric, "date": dates, "categorical": []}).insight_trends()


def insight_performance_gap(df: DataFrame, categories: list[str], numeric: list[str]) -> DataFrame:
    return Analysis(df, {"numeric": numeric, "date": [], "categorical": categories}).insight_performance_gap()


def insight_correlation(df: DataFrame, numeric: list[str]) -> DataFrame:
    return Analysis(df, {"numeric": numeric, "date": [], "categorical": []}).insight_correlation()


def insight_risk(df: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    return Analysis(df, classes).insight_risk()


def business_insights(df: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    return Analysis(df, classes).insights


def recommendations(df: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    return Analysis(df, classes).recommendations


def executive_summary(df: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    return Analysis(df, classes).summary


def dashboard_findings(df: DataFrame, schema: dict[str, str], filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """(seq, rule, subject, value, detail): findings on the filtered rows, in rule order; the first ``limit`` if given."""
    part = apply_filters(df, filters or {})
    kinds = lambda *t: [c for c in df.columns if schema.get(c) in t]
    nums, texts, dates = kinds("NUM"), kinds("TEXT", "MIXED"), kinds("DATE")
    place = lambda names: F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))

    place_of = lambda name: F.array_position(F.array(*[F.lit(c) for c in nums]), F.col(name))

    def found(frame, rule, order, name, subject, v, detail=F.lit(None)):
        return frame.select(F.lit(rule).alias("rule_no"), order.cast("bigint").alias("place"), F.lit(name).alias("rule"),
                            subject.cast("string").alias("subject"), v.cast("double").alias("value"),
                            detail.cast("string").alias("detail"))

    total = part.agg(F.count("*").alias("n"))
    share = F.try_divide(F.col("nulls") * 100, F.col("n"))
    nulls = quality.null_counts(part).withColumn("n", total.scalar()).where(share > 5)
    copies = quality.duplicate_count(part)
    repeated = F.try_divide(F.col("duplicates") * 100, F.col("rows"))
    parts = [
        found(nulls, 1, place(df.columns), "missing", F.col("column"), F.round(share, 1)),
        found(copies.where(repeated > 1), 2, F.lit(0), "duplicates", F.lit("rows"), F.round(repeated, 1)),
    ]
    if nums:
        parts.append(found(stats.iqr_outliers(part, nums, 11), 3, place(nums), "outliers", F.col("column"), F.col("total_outliers")))
    for i, t in enumerate(texts if nums else []):
        dominant = segments.dominant_category(part, t, nums[0]).where("dominant")
        parts.append(found(dominant, 4, F.lit(i), "concentration", F.col("column"), F.round("share_pct", 1), F.col("category")))
    if len(nums) >= 2:
        strong = stats.strong_correlations(part, nums).withColumn("column", F.col("var1"))
        order = place_of("var1") * len(nums) + place_of("var2")
        parts.append(found(strong, 5, order, "correlation", F.concat_ws(" / ", "var1", "var2"), F.round("r", 2), F.col("strength")))
    if dates and nums:
        moved = timeseries.trend_by_date(part, dates[0], nums[0])
        parts.append(found(moved, 6, F.lit(0), "trend", F.col("metric"), F.col("change_pct"), F.col("direction")))
    n = total.first()["n"]
    every = union_all(parts)                                                   # a few rows per column or pair of columns
    first = fetched(every if limit is None else every.orderBy("rule_no", "place").limit(limit))
    if n == 0 or first.isEmpty():
        first = literal_rows(df, [
            (7, 0, "summary", "rows", float(n), f"{len(df.columns)} columns") if n else (8, 0, "no data", "rows", 0.0, None)
        ], first.schema)
    seq = F.row_number().over(W.partitionBy().orderBy("rule_no", "place"))
    return first.select(seq.alias("seq"), "rule", "subject", "value", "detail")


def full_report(df: DataFrame, classes: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The sections of the report as frames (performance in several: means, records and segments).

    They share one Analysis, so every statistic is computed once.
    """
    a = Analysis(df, classes)
    shape = literal_rows(df, [(c, kind, df.columns.index(c)) for kind, names in a.classes.items() for c in names],
                         "column string, class string, position int")
    performance = empty_like(df, "metric string, top_mean double, bottom_mean double, gap double")
    gaps = segments.segment_gap(df, [], "")
    shown = [*([a.metric] if a.metric else []), *a.categories[:2]]             # a record shows two categories, as headings
    best = worst = df.select(*[col(c) for c in shown]).limit(0)
    if a.metric:
        performance = rows.top_bottom_summary(df, a.metric)
        best, worst = (pick(df, a.metric, 10, shown[1:]).select(*[col(c) for c in shown]) for pick in (rows.top_n, rows.bottom_n))
        gaps = segments.segment_gap(df, a.categories, a.metric)
    return {
        "overview": shape, "size": quality.dataset_size(df), "quality": quality.missing_profile(df), "duplicates": a.duplicates,
        "constant": quality.empty_and_constant(df), "statistics": a.statistics, "notable": stats.notable_stats(a.statistics), "outliers": a.outliers,
        "correlation": a.correlations, "trends": a.trends, "trend_counts": timeseries.trend_counts(a.trends),
        "categories": segments.category_analysis(df, a.categories, a.metric, a.category_table),
        "performance": performance, "top_records": best, "bottom_records": worst, "segment_gaps": gaps, "anomalies": a.anomalies, "insights": a.insights,
        "recommendations": a.recommendations, "summary": a.summary,
    }
