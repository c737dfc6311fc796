"""Data quality: missing values, duplicates, consistency, per-column profile, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabulight.functions import vocab
from tabulight.functions.columns import (
    count_if, data_type, is_datetime, is_floating, is_numeric, is_text, missing_sql, name_sql, names_where,
    number_sql, percent, severity, strip_sql, timestamp_sql, value, value_sql,
)
from tabulight.operators.rows import COPIES, repeated_rows, sample_values
from tabulight.operators.schema import semantic_types
from tabulight.operators.stats import iqr_outliers_basic
from tabulight.plans.dates import dated_sql
from tabulight.plans.profile import (
    column_profile, distinct_profile, fetched, literal_rows, union_all,
)

CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LOOKS_NUMERIC = r"^(?=.*[0-9])(?!.*-.*-)(?!.*\..*\.)[0-9.\-]+$"   # digits with at most one "-" and one "."


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls): NULL or NaN."""
    return column_profile(df, df.columns, {"nulls": ("bigint", _count_missing(df, "M0"))}).drop("position")


def _count_missing(df: DataFrame, level: str):
    return lambda c: f"count_if({missing_sql(df, c, level)})"


def _rows(c: str) -> str:
    return "count(*)"


def _missing(df: DataFrame) -> DataFrame:
    return column_profile(df, df.columns, {
        "rows": ("bigint", _rows), "nulls": ("bigint", _count_missing(df, "M0")),
        "total_missing": ("bigint", _count_missing(df, "M3")),
    })


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values (NULL or a missing-value word), with share and severity."""
    pct = percent(F.col("total_missing"), F.col("rows"))
    return _missing(df).where("total_missing > 0").select(
        "column", "nulls", F.col("total_missing").alias("blanks"), "total_missing",
        pct.alias("missing_pct"), severity(pct, 20, 5).alias("severity"))


def missing_totals(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, counting NULLs only and counting words too."""
    cells = F.sum("rows")
    return _missing(df).agg(
        F.sum("total_missing").alias("missing_cells"), percent(F.sum("total_missing"), cells).alias("missing_pct"),
        F.sum("nulls").alias("null_cells"), percent(F.sum("nulls"), cells).alias("null_pct"),
        F.count(F.when(F.col("total_missing") > 0, 1)).alias("columns_with_missing"))


def null_blank_report(df: DataFrame) -> DataFrame:
    """(column, nulls, blanks, total_missing, missing_pct) with blank meaning empty text."""
    blank = lambda c: f"count_if(trim({name_sql(c)}) = '')" if is_text(df, c) else "0L"
    total = F.col("nulls") + F.col("blanks")
    return column_profile(df, df.columns, {
        "rows": ("bigint", _rows), "nulls": ("bigint", _count_missing(df, "M0")), "blanks": ("bigint", blank),
    }).select("column", "nulls", "blanks", total.alias("total_missing"), percent(total, F.col("rows")).alias("missing_pct"))


def missing_panel(df: DataFrame, schema: dict[str, str], search: str = "", ascending: bool = False) -> DataFrame:
    """Columns with fillable gaps (NULL, blank, nan, undefined), most gaps first."""
    kinds = literal_rows(df, [
        (c, {"NUM": "Numeric", "DATE": "Date"}.get(schema.get(c), "Categorical")) for c in df.columns
    ], "column string, data_type string")
    panel = column_profile(df, df.columns, {
        "missing_count": ("bigint", _count_missing(df, "M2")), "total_rows": ("bigint", _rows),
    }).where("missing_count > 0").join(F.broadcast(kinds), "column")
    if search:
        panel = panel.where(F.lower("column").contains(search.lower()))
    order = F.asc("missing_count") if ascending else F.desc("missing_count")
    return panel.orderBy(order, "position").select(
        "column", "data_type", "missing_count", "total_rows",
        F.sum("missing_count").over(W.partitionBy()).alias("total_missing"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, duplicates, duplicate_pct, severity): copies beyond the first of each row."""
    pct = percent(F.col("duplicates"), F.col("rows"))
    copies = repeated_rows(df).agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicates"))
    return copies.withColumn("rows", df.agg(F.count("*")).scalar()).select(
        "rows", "duplicates", pct.alias("duplicate_pct"), severity(pct, 10, 3).alias("severity"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(duplicate_groups): distinct rows that occur more than once."""
    return repeated_rows(df).agg(F.count("*").alias("duplicate_groups"))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, distinct_count) of non-null values."""
    return distinct_profile(df, df.columns, lambda c: value_sql(df, c), approx)


def _spread(df: DataFrame) -> DataFrame:
    """(column, position, filled, constant): one distinct value shows as minimum = maximum."""
    def same(c: str) -> str:
        v = value_sql(df, c)
        ordered = isinstance(data_type(df, c), T.AtomicType)
        return f"coalesce({f'min({v}) = max({v})' if ordered else f'count(distinct {v}) = 1'}, false)"

    return column_profile(df, df.columns, {
        "filled": ("bigint", lambda c: f"count({value_sql(df, c)})"), "constant": ("boolean", same),
    })


def empty_and_constant(df: DataFrame) -> DataFrame:
    """(column, kind) with kind empty or constant."""
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("constant"), "constant")
    return _spread(df).select("column", kind.alias("kind")).where("kind is not null")


def consistency_pct(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(checked, bad, consistency_pct): values that parse as their declared type."""
    parse = {"NUM": number_sql, "MIXED": number_sql, "DATE": timestamp_sql}
    checked = [c for c in df.columns if schema.get(c) in parse]
    facts = column_profile(df, checked, {
        "checked": ("bigint", lambda c: f"count({value_sql(df, c)})"),
        "good": ("bigint", lambda c: f"count({parse[schema[c]](df, c)})"),
    }).agg(F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"),
           F.coalesce(F.sum(F.col("checked") - F.col("good")), F.lit(0)).alias("bad"))
    good = 1 - F.col("bad") / F.greatest(F.col("checked"), F.lit(1))
    return facts.select("checked", "bad", F.round(100 * good, 2).alias("consistency_pct"))


def _encoding(df: DataFrame):
    def count(c: str) -> str:
        if not is_text(df, c):
            return "0L"
        return f"count_if(contains({name_sql(c)}, '\\ufffd')) + count_if({name_sql(c)} rlike r'{CONTROL_CHARACTERS}')"
    return count


def encoding_issues(df: DataFrame) -> DataFrame:
    """(column, issues): text with replacement characters plus text with control characters."""
    return column_profile(df, names_where(df, is_text), {"issues": ("bigint", _encoding(df))}).where("issues > 0").drop("position")


def mixed_and_whitespace(df: DataFrame) -> DataFrame:
    """(column, issue): numbers among other text; padded values in columns with 2-20 values."""
    texts = names_where(df, is_text)
    facts = column_profile(df, texts, {
        "filled": ("bigint", lambda c: f"count({name_sql(c)})"),
        "numeric": ("bigint", lambda c: f"count_if({name_sql(c)} rlike r'{LOOKS_NUMERIC}')"),
        "padded": ("boolean", lambda c: f"coalesce(bool_or({strip_sql(name_sql(c))} != {name_sql(c)}), false)"),
    }).join(F.broadcast(distinct_profile(df, texts, name_sql)), "column")
    mixed = facts.where("numeric > 0 AND numeric < filled").select("column", F.lit("mixed types").alias("issue"))
    padded = facts.where("padded AND distinct_count BETWEEN 2 AND 20").select("column", F.lit("outer whitespace").alias("issue"))
    return mixed.unionByName(padded)


def column_quality(df: DataFrame, schema: dict[str, str], outliers: DataFrame | None = None,
                   distinct: DataFrame | None = None) -> DataFrame:
    """One row per column: type, gaps, distinct values, outliers and the list of issues."""
    numeric = [c for c in df.columns if schema.get(c) == "NUM" and is_numeric(df, c)]
    outliers = iqr_outliers_basic(df, numeric) if outliers is None else outliers
    distinct = distinct_counts(df) if distinct is None else distinct
    types = literal_rows(df, [(c, schema.get(c, "TEXT")) for c in df.columns], "column string, type string")
    facts = column_profile(df, df.columns, {
        "rows": ("bigint", _rows), "missing": ("bigint", _count_missing(df, "M3")), "bad_text": ("bigint", _encoding(df)),
    })
    pct = percent(F.col("missing"), F.col("rows"), 1)
    ambiguous = F.col("type").isin("TEXT", "MIXED")
    return (
        facts.join(F.broadcast(types), "column").join(F.broadcast(distinct), "column")
        .join(F.broadcast(outliers), "column", "left").na.fill(0, ["outliers"])
        .select(
            "column", "position", "type", "missing", pct.alias("missing_pct"), F.col("distinct_count").alias("unique"),
            "outliers",
            F.array_compact(F.array(
                F.when(F.col("missing") > 0, "missing values"),
                F.when(F.col("outliers") > 0, "outliers"),
                F.when(F.col("type") == "MIXED", "mixed types"),
                F.when(F.col("bad_text") > 0, "encoding"),
                F.when((F.col("distinct_count") == 1) & (F.col("missing") < F.col("rows")), "constant"),
                F.when((F.col("distinct_count") == F.col("rows")) & ambiguous, "all unique"),
            )).alias("issues"),
        )
    )


def key_fields(df: DataFrame, schema: dict[str, str], distinct: DataFrame | None = None) -> DataFrame:
    """(role, column): the id, the date column and up to five measures.

    Walking the columns in order, an id is the first id-like name with mostly unique values,
    the date the first DATE type or date-like name; the NUM columns left over are measures.
    """
    distinct = distinct_counts(df) if distinct is None else distinct
    facts = column_profile(df, df.columns, {
        "rows": ("bigint", _rows), "filled": ("bigint", lambda c: f"count({value_sql(df, c)})"),
        "variance": ("double", lambda c: f"var_samp({number_sql(df, c)})" if schema.get(c) == "NUM" else "null"),
    }).join(F.broadcast(distinct), "column")
    share = F.col("distinct_count") / F.greatest(F.col("filled"), F.lit(1))
    parts = F.split(F.regexp_replace(F.lower(F.trim("column")), "[_\\s]+", " "), " ")
    hinted = lambda words: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
    types = literal_rows(df, [(c, schema.get(c, "TEXT")) for c in df.columns], "column string, type string")
    rows = facts.join(F.broadcast(types), "column").select(
        "column", "position", "type", "variance", share.alias("share"),
        (hinted(vocab.ID_HINTS) & (share >= 0.7)).alias("id_like"),
        ((F.col("type") == "DATE") | hinted(vocab.DATE_HINTS)).alias("date_like"),
        (F.col("filled") == F.col("rows")).alias("whole"),
    )
    table = W.partitionBy()     # one row per column of the profiled table
    rows = rows.withColumn("id_at", F.min(F.when(F.col("id_like"), F.col("position"))).over(table))
    free = F.coalesce(F.col("position") != F.col("id_at"), F.lit(True))
    rows = rows.withColumn("date_at", F.min(F.when(F.col("date_like") & free, F.col("position"))).over(table))
    measure = (F.col("type") == "NUM") & free & F.coalesce(F.col("position") != F.col("date_at"), F.lit(True))
    candidate = F.when(F.col("id_at").isNull() & F.col("whole") & (F.col("share") >= 0.95),
                       F.struct("share", "column"))
    rows = (
        rows.withColumn("measure", measure).withColumn("fallback", F.max(candidate).over(table))
        .withColumn("measures", F.sum(F.col("measure").cast("int")).over(table))
    )
    by_variance = F.row_number().over(W.partitionBy("measure").orderBy(F.desc_nulls_last("variance"), "position"))
    by_place = F.row_number().over(W.partitionBy("measure").orderBy("position"))
    rows = rows.withColumn("place", F.when(F.col("measures") > 5, by_variance).otherwise(by_place))
    roles = [
        (F.lit("id"), (F.col("position") == F.col("id_at")) | (F.col("column") == F.col("fallback.column")), F.lit(1)),
        (F.lit("date"), F.col("position") == F.col("date_at"), F.lit(1)),
        (F.lit("measure"), F.col("measure"), F.col("place")),
    ]
    return rows.select(F.inline(F.array_compact(F.array(*[
        F.when(test, F.struct(role.alias("role"), rank.alias("rank"), F.col("column"))) for role, test, rank in roles
    ]))))


def type_distribution(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(type, columns): how many columns have each semantic type, including zero."""
    counts = {t: 0 for t in ("NUM", "TEXT", "DATE", "BOOL", "MIXED")}
    for c in df.columns:
        counts[schema.get(c, "TEXT")] += 1
    if counts["BOOL"] == 0:
        for c, found in semantic_types(df).items():
            if found == "BOOL":
                counts["BOOL"] += 1
                source = "NUM" if schema.get(c) == "NUM" else "TEXT"
                counts[source] = max(0, counts[source] - 1)
    return literal_rows(df, list(counts.items()), "type string, columns bigint")


def dataset_size(df: DataFrame) -> DataFrame:
    """(bytes, label): fixed widths plus the bytes of text values."""
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    fixed, parts = 0, []
    for c in df.columns:
        kind = data_type(df, c)
        if is_text(df, c) or isinstance(kind, T.BinaryType):
            parts.append(f"coalesce(sum(octet_length({name_sql(c)})), 0)")
        elif isinstance(kind, T.AtomicType):
            fixed += widths.get(type(kind), 8)
        else:
            parts.append(f"coalesce(sum(octet_length(to_json(struct({name_sql(c)})))), 0)")
    total = F.expr(" + ".join([f"count(*) * {fixed}", *parts]))
    mb = F.round(F.col("bytes") / (1024 * 1024), 2)
    label = F.when(mb < 1, F.concat(F.round(F.col("bytes") / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(
        F.concat(mb.cast("string"), F.lit(" MB")))
    return df.agg(total.cast("bigint").alias("bytes")).select("bytes", label.alias("label"))


def storage_label(df: DataFrame, c: str, semantic: str) -> str:
    if semantic == "NUM":
        return "REAL" if is_floating(df, c) or is_text(df, c) or isinstance(data_type(df, c), T.DecimalType) else "INTEGER"
    return {"DATE": "DATE", "BOOL": "BOOLEAN", "MIXED": "MIXED"}.get(semantic, "TEXT")


def schema_details(df: DataFrame, schema: dict[str, str], distinct: DataFrame | None = None) -> DataFrame:
    """(column, position, storage_type, null_count, unique_count, sample_values)."""
    distinct = distinct_counts(df) if distinct is None else distinct
    labels = literal_rows(df, [(c, i, storage_label(df, c, schema.get(c, "TEXT"))) for i, c in enumerate(df.columns)],
                          "column string, position int, storage_type string")
    samples = sample_values(df).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]).alias("sample_values"))
    return (
        labels.join(F.broadcast(null_counts(df)), "column").join(F.broadcast(distinct), "column")
        .join(F.broadcast(samples), "column", "left")
        .select("column", "position", "storage_type", F.col("nulls").alias("null_count"),
                F.col("distinct_count").alias("unique_count"), F.coalesce("sample_values", F.array()).alias("sample_values"))
    )


def meaning_tag(name: str) -> str | None:
    lower = name.lower().replace(" ", "_").replace("-", "_")
    return next((tag for tag, words in vocab.MEANING_TAGS.items() if any(w in lower for w in words)), None)


def catalog_profile(df: DataFrame) -> DataFrame:
    """What a reader needs to know about each column: range, average, distinct values, examples."""
    kinds = {}
    for c in df.columns:
        dated = is_datetime(df, c) or meaning_tag(c) == "date"
        kinds[c] = "number" if is_numeric(df, c) else "date" if dated else "other"
    def of(kind: str, make: str):
        return lambda c: make.format(number_sql(df, c) if kind == "number" else name_sql(c)) if kinds[c] == kind else "null"

    facts = column_profile(df, df.columns, {
        "nulls": ("bigint", _count_missing(df, "M1")),
        "min_number": ("double", of("number", "min({})")), "max_number": ("double", of("number", "max({})")),
        "average": ("double", of("number", "round(avg({}), 2)")),
        "min_text": ("string", of("date", "min({})")), "max_text": ("string", of("date", "max({})")),
    })
    tags = literal_rows(df, [(c, meaning_tag(c), kinds[c]) for c in df.columns], "column string, meaning string, kind string")
    counted = [c for c in df.columns if kinds[c] != "date"]
    distinct = distinct_profile(df, counted, lambda c: value_sql(df, c))
    small = [r["column"] for r in distinct.where("distinct_count <= 30").collect() if kinds[r["column"]] == "other"]
    values = column_profile(df, small, {    # at most 30 distinct values each, known from the count
        "values": ("array<string>", lambda c: f"array_sort(collect_set(cast({name_sql(c)} as string)))"),
    }).drop("position")
    return (
        facts.join(F.broadcast(tags), "column").join(F.broadcast(distinct), "column", "left")
        .join(F.broadcast(values), "column", "left")
        .select("column", "position", "kind", "meaning", "nulls", "min_number", "max_number", "average",
                "distinct_count", "min_text", "max_text", "values")
    )



def quality_label(df: DataFrame) -> DataFrame:
    """(null_cells, duplicates, label): EXCELLENT, GOOD, FAIR or POOR."""
    facts = _one_row(missing_totals(df), duplicate_count(df))
    none = (F.col("null_cells") == 0) & (F.col("duplicates") == 0)
    within = lambda a, b: (F.col("null_pct") < a) & (F.col("duplicate_pct") < b)
    return facts.select("null_cells", "duplicates",
                        F.when(none, "EXCELLENT").when(within(5, 3), "GOOD").when(within(15, 10), "FAIR")
                        .otherwise("POOR").alias("label"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, each read as a scalar subquery."""
    first, *rest = frames
    for frame in rest:
        packed = frame.select(F.struct(*frame.columns)).scalar()
        first = first.withColumn("_packed", packed).select("*", *[
            F.col("_packed").getField(c).alias(c) for c in frame.columns]).drop("_packed")
    return first


def trust_score(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(score, band, flags): 100 minus penalties for gaps, copies, few rows and bad dates."""
    dates = [c for c in df.columns if schema.get(c) == "DATE"][:1]
    gaps = null_counts(df).agg(
        F.sum("nulls").alias("null_cells"),
        # at most one entry per column of the table
        F.array_sort(F.collect_list(F.when(F.col("nulls") > 0, F.struct("column", "nulls")))).alias("gaps"))
    bad = f"count({value_sql(df, dates[0])}) - count({timestamp_sql(df, dates[0])})" if dates else "0L"
    parsed = df.agg(F.count("*").alias("table_rows"), F.expr(bad).alias("bad_dates"))
    facts = _one_row(parsed, gaps, duplicate_count(df).select("duplicates"))
    rows, cells = F.col("table_rows"), F.col("table_rows") * len(df.columns)
    penalty = (
        F.least(F.lit(20.0), F.coalesce(F.try_divide(F.col("null_cells") * 200.0, cells), F.lit(0.0)))
        + F.least(F.lit(10.0), F.coalesce(F.try_divide(F.col("duplicates") * 200.0, rows), F.lit(0.0)))
        + F.when(rows < 30, 20.0).otherwise(0.0) + F.when(F.col("bad_dates") > 0, 10.0).otherwise(0.0))
    score = F.greatest(F.lit(0), F.floor(100 - penalty).cast("int"))
    flags = F.concat(
        F.when(F.col("bad_dates") > 0, F.array(F.concat(F.lit("unparseable dates: "), F.lit(dates[0] if dates else ""))))
        .otherwise(F.array().cast("array<string>")),
        F.transform("gaps", lambda g: F.concat(F.lit("nulls: "), g["column"])),
        F.when(F.col("duplicates") > 0, F.array(F.lit("duplicate rows"))).otherwise(F.array().cast("array<string>")))
    return facts.select(score.alias("score"), flags.alias("flags")).select(
        "score", F.when(F.col("score") >= 85, "good").when(F.col("score") >= 60, "warning").otherwise("poor").alias("band"),
        "flags")


def forecast_safety(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(safe, reason): a forecast needs a date column, 10 rows and 4 distinct dates."""
    dates = [c for c in df.columns if schema.get(c) == "DATE"][:1]
    if not dates:
        return literal_rows(df, [(False, "no date column")], "safe boolean, reason string")
    facts = df.agg(F.count("*").alias("n"), F.count_distinct(value(df, dates[0])).alias("d"))
    reason = F.when(F.col("n") < 10, "too few rows").when(F.col("d") < 4, "too few periods").otherwise("ok")
    return facts.select((reason == "ok").alias("safe"), reason.alias("reason"))


def date_range(df: DataFrame, name: str) -> DataFrame:
    """(first_date, last_date) as yyyy-MM-dd."""
    day = dated_sql(df, name)
    return df.agg(F.expr(f"date_format(min({day}), 'yyyy-MM-dd') as first_date"),
                  F.expr(f"date_format(max({day}), 'yyyy-MM-dd') as last_date"))


def quality_facts(df: DataFrame, schema: dict[str, str], outliers: DataFrame | None = None) -> DataFrame:
    """One row with every table-level number of the overview."""
    numeric = [c for c in df.columns if schema.get(c) == "NUM" and is_numeric(df, c)]
    outliers = iqr_outliers_basic(df, numeric) if outliers is None else outliers
    spread = empty_and_constant(df).agg(
        count_if(F.col("kind") == "empty").alias("empty_columns"),
        count_if(F.col("kind") == "constant").alias("constant_columns"))
    out = outliers.agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outlier_count"),
                       F.count("*").alias("outlier_columns"))
    encoding = encoding_issues(df).agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("encoding_issues"),
                                       F.count("*").alias("encoding_issue_columns"))
    facts = _one_row(
        duplicate_count(df).drop("severity"), missing_totals(df), spread, out, encoding,
        consistency_pct(df, schema).select("consistency_pct"), dataset_size(df))
    return facts.withColumn("total_columns", F.lit(len(df.columns)).cast("bigint")).withColumn(
        "mixed_type_columns", F.lit(sum(t == "MIXED" for t in schema.values())).cast("bigint"))


ISSUE_RULES = [
    ("missing values", "missing_cells"), ("duplicate rows", "duplicates"), ("empty columns", "empty_columns"),
    ("constant columns", "constant_columns"), ("outliers", "outlier_count"),
    ("mixed type columns", "mixed_type_columns"), ("encoding issues", "encoding_issues"),
]


def issue_list(df: DataFrame, schema: dict[str, str], facts: DataFrame | None = None) -> DataFrame:
    """(seq, issue, value): the rules that fire, in report order."""
    facts = quality_facts(df, schema) if facts is None else facts
    rules = [F.when(F.col(f) > 0, F.struct(F.lit(i).alias("seq"), F.lit(label).alias("issue"), F.col(f).cast("double").alias("value")))
             for i, (label, f) in enumerate(ISSUE_RULES, 1)]
    rules.append(F.when(F.col("consistency_pct") < 95, F.struct(
        F.lit(len(rules) + 1).alias("seq"), F.lit("low consistency").alias("issue"), F.col("consistency_pct").alias("value"))))
    return facts.select(F.inline(F.array_compact(F.array(*rules))))


def overview(df: DataFrame, schema: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All parts of the overview. Distinct counts and outliers are computed once and shared."""
    schema = schema or semantic_types(df)
    numeric = [c for c in df.columns if schema.get(c) == "NUM" and is_numeric(df, c)]
    distinct, outliers = fetched(distinct_counts(df)), fetched(iqr_outliers_basic(df, numeric))
    facts = fetched(quality_facts(df, schema, outliers))
    return {
        "facts": facts, "types": type_distribution(df, schema), "keys": key_fields(df, schema, distinct),
        "issues": issue_list(df, schema, facts), "column_quality": column_quality(df, schema, outliers, distinct),
        "schema_details": schema_details(df, schema, distinct),
    }


def overview_report(df: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """The overview as (section, metric, value) text rows."""
    schema = schema or semantic_types(df)
    parts = overview(df, schema)
    labels = [
        ("table", "rows", F.col("rows").cast("string")),
        ("table", "columns", F.col("total_columns").cast("string")),
        ("table", "size", F.col("label")),
        ("quality", "missing_cells", F.col("missing_cells").cast("string")),
        ("quality", "missing_pct", F.col("missing_pct").cast("string")),
        ("quality", "duplicates", F.col("duplicates").cast("string")),
        ("quality", "empty_columns", F.col("empty_columns").cast("string")),
        ("quality", "consistency_pct", F.col("consistency_pct").cast("string")),
    ]
    row = lambda s, m, v: F.struct(F.lit(s).alias("section"), m.alias("metric"), v.alias("value"))
    summary = parts["facts"].select(F.inline(F.array(*[row(s, F.lit(m), v) for s, m, v in labels])))
    names = {"NUM": "numeric", "TEXT": "text", "DATE": "date", "BOOL": "boolean"}
    kinds = F.create_map(*[x for k, n in names.items() for x in (F.lit(k), F.lit(n))])
    types = parts["types"].where(F.col("type").isin(list(names))).select(
        F.lit("types").alias("section"), F.element_at(kinds, F.col("type")).alias("metric"),
        F.col("columns").cast("string").alias("value"))
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("role") == role, F.struct("rank", "column")))), lambda s: s["column"]), ", ")
    keys = parts["keys"].agg(joined("id").alias("id"), joined("date").alias("date"), joined("measure").alias("m")).select(
        F.inline(F.array(*[row("keys", F.lit(label), F.when(F.col(c) == "", "none").otherwise(F.col(c)))
                           for label, c in (("id", "id"), ("date", "date"), ("measures", "m"))])))
    samples = F.when(F.size("sample_values") == 0, "None").otherwise(F.array_join("sample_values", ", "))
    details = parts["schema_details"].select(
        F.lit("columns").alias("section"), F.col("column").alias("metric"),
        F.concat("storage_type", F.lit(": "), samples).alias("value"))
    return union_all([summary, types, keys, details])
