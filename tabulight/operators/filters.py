"""Row filters, text search, projections and guarded user SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulight.functions import vocab
from tabulight.functions.columns import both, col, either, is_floating, names_where


def resolve_name(name: str, columns: list[str]) -> str | None:
    """The column meant by a name, ignoring case, spaces and underscores."""
    if name in columns:
        return name
    plain = lambda s: re.sub(r"[ _]", "", s.lower())
    return next((c for c in columns if name and plain(c) == plain(name)), None)


def filter_eq(df: DataFrame, name: str, wanted) -> DataFrame:
    return df.where(col(name) == F.lit(wanted))


def filter_in(df: DataFrame, name: str, wanted: list) -> DataFrame:
    """Rows with one of the values; NULL, blank and "none" placeholders in the list are ignored."""
    condition = _condition(name, list(wanted))
    return df if condition is None else df.where(condition)


def filter_range(df: DataFrame, name: str, start=None, end=None) -> DataFrame:
    """Rows within the closed range; either end may be open."""
    condition = _condition(name, {"start": start, "end": end})
    return df if condition is None else df.where(condition)


def _blank(v) -> bool:
    return v is None or v == "" or v == [] or v in ("none", "None") or v in (["none"], ["None"])


def _condition(name: str, spec) -> Column | None:
    if _blank(spec):
        return None
    if isinstance(spec, dict):
        ends = [col(name) >= F.lit(spec["start"])] if spec.get("start") not in (None, "") else []
        ends += [col(name) <= F.lit(spec["end"])] if spec.get("end") not in (None, "") else []
        return both(ends) if ends else None
    if isinstance(spec, (list, tuple, set)):
        kept = [v for v in spec if v not in (None, "") and str(v).lower() != "none"]
        if not kept:
            return None
        return col(name) == F.lit(kept[0]) if len(kept) == 1 else col(name).isin(kept)
    return col(name) == F.lit(spec)


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """All filters together: {column: value | [values] | {"start": a, "end": b}}.

    Unknown columns and empty specifications are skipped. The conditions are plain column
    comparisons, so they reach the file scan.
    """
    conditions = []
    for name, spec in (filters or {}).items():
        resolved = resolve_name(name, df.columns)
        condition = _condition(resolved, spec) if resolved else None
        if condition is not None:
            conditions.append(condition)
    return df.where(both(conditions)) if conditions else df


def cross_filter(filters: dict, name: str, clicked=None) -> dict:
    """The filters after clicking a chart value; without a value the column's filter is removed."""
    rest = {k: v for k, v in (filters or {}).items() if k != name}
    return rest if clicked is None else {**rest, name: [clicked]}


def search_text(df: DataFrame, text: str, schema: dict[str, str]) -> DataFrame:
    """Rows whose TEXT or MIXED columns contain the text, ignoring case; % and _ are wildcards."""
    columns = [c for c in df.columns if schema.get(c) in ("TEXT", "MIXED")]
    if not text or not columns:
        return df
    pattern = "%" + text.replace("\\", "\\\\") + "%"       # a backslash is an ordinary character here
    return df.where(either([col(c).cast("string").ilike(pattern) for c in columns]))


def keyword_search(df: DataFrame, question: str, columns: list[str]) -> DataFrame:
    """Rows matching the first question word (over 2 letters) that any text column contains.

    One aggregate finds out which (word, column) pairs occur at all; the first one filters.
    """
    words = [w for w in question.lower().strip().split() if len(w) > 2]
    pairs = [(w, c) for w in dict.fromkeys(words) for c in columns]
    if not pairs:
        return df.limit(0)
    hit = lambda w, c: F.contains(F.lower(col(c)), F.lit(w))
    found = df.agg(*[F.bool_or(hit(w, c)).alias(f"p{i}") for i, (w, c) in enumerate(pairs)]).first()
    first = next((p for i, p in enumerate(pairs) if found[i]), None)
    return df.where(hit(*first)) if first else df.limit(0)


def project(df: DataFrame, metric: str, categories: list[str]) -> DataFrame:
    """The metric with the categorical columns."""
    return df.select(col(metric), *[col(c) for c in categories])


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL."""
    floats = names_where(df, is_floating)
    finite = lambda c: ~F.isnan(col(c)) & (F.abs(col(c)) != F.lit(float("inf")))
    return df.select(*[F.when(finite(c), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


class RejectedQuery(ValueError):
    """User SQL that is not a plain read of the given views."""


def sql_readonly(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """Run a user's SELECT over the named views.

    The text is cut to its first SELECT/WITH, must not contain a changing keyword, must
    mention a view and must analyse; Spark then plans it like any other query. What a SELECT or
    WITH can also start in Spark - MERGE, scripts, calls into the JVM - is refused as well.
    """
    text = re.sub(r"```(sql)?\s*", "", query.strip(), flags=re.IGNORECASE).strip()
    start = re.search(r"\b(SELECT|WITH)\b", text, re.IGNORECASE)
    if not start:
        raise RejectedQuery("only SELECT or WITH queries can be run")
    text = text[start.start():].strip().rstrip(";")
    for word in vocab.DENIED_SQL_WORDS + ["MERGE", "reflect", "try_reflect", "java_method"]:
        if re.search(rf"\b{word}\b", text, re.IGNORECASE):
            raise RejectedQuery(f"{word} is not allowed")
    if re.search(r"\b(TRANSFORM|MAP|REDUCE)\b.*\bUSING\s*['\"]", text, re.IGNORECASE | re.DOTALL):
        raise RejectedQuery("scripts are not allowed")
    if not any(re.search(rf"\b{re.escape(v)}\b", text, re.IGNORECASE) for v in views):
        raise RejectedQuery("the query mentions none of the views: " + ", ".join(sorted(views)))
    foreign = _relations(spark, text) - {v.lower() for v in views}
    if foreign:
        raise RejectedQuery("only the given views can be read, not " + ", ".join(sorted(foreign)))
    before = {name: spark.table(name) for name in views if any(v.isTemporary for v in spark.catalog.listTables(pattern=name) if v.name.lower() == name.lower())}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    try:
        found = spark.sql(text)         # analysed here, so the views are not needed later
        foreign = _read_beyond(found._jdf.queryExecution().analyzed(), {v.lower() for v in views})
        if foreign:
            raise RejectedQuery("only the given views can be read, not " + ", ".join(sorted(foreign)))
        return found
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, frame in before.items():
            frame.createOrReplaceTempView(name)


def _relations(spark: SparkSession, text: str) -> set[str]:
    """The tables, views and paths that a query reads, its own WITH names left out. Spark's parser finds them."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    except Exception as problem:
        raise RejectedQuery(str(problem).splitlines()[0]) from None
    own = {name.strip().lower() for names in re.findall(r"\bCTE \[([^\]]*)\]", plan) for name in names.split(",")}
    read = {", ".join(part.strip() for part in names.split(",")).lower() for names in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)}
    return read - own


#: Leaves of an analysed plan that hold no table: constants, ranges, references to the query's own WITH parts.
OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}


def _read_beyond(plan, views: set[str]) -> set[str]:
    """What an analysed query reads besides the views: names are resolved there, so a WITH part that bears a table's name hides nothing.

    The walk ends at the given views, whatever they read themselves; it goes through WITH parts and subqueries.
    """
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        name = plan.desc().identifier().table().lower()
        return set() if plan.isTempView() and name in views else {name}
    below = [seq.apply(i) for seq in (plan.children(), plan.subqueries()) for i in range(seq.size())]
    if not below and kind not in OWN_LEAVES:
        return {plan.simpleStringWithNodeId().split("\n")[0][:80]}
    return set().union(*(_read_beyond(part, views) for part in below)) if below else set()
