from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.registry import each, query
from checks.stats import WIDE_TEXTS, over_wider, wider
from tabulight.operators import filters, quality, segments
from tabulight.plans.profile import union_all

ORDER_TYPES = {"o_orderkey": "NUM", "o_custkey": "NUM", "o_orderstatus": "TEXT", "o_totalprice": "NUM",
               "o_orderdate": "DATE", "o_orderpriority": "TEXT"}
PRICE_FIRST = {k: ORDER_TYPES[k] for k in ("o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")}
BUSY_TYPES = {"order_no": "NUM", "ordered_on": "DATE", "price": "NUM", "refund": "NUM", "status": "TEXT", "priority": "TEXT",
              "clerk": "TEXT"}


def cents(e: str) -> str:
    """Exact sum of money in SQL, so the order of addition cannot show."""
    return f"CAST(sum(CAST({e} AS DECIMAL(18,2))) AS DOUBLE)"


@query("f01_row_count", "SELECT count(*) AS total_rows FROM lineitem")
def _(t):
    return segments.row_count(t.lineitem)


@query("f02_column_averages", each(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                    "l_discount", "l_tax"], "SELECT '{c}' AS \"column\", round(avg({c}), 2) AS average FROM lineitem"))
def _(t):
    return segments.column_averages(t.lineitem, [c for c, k in t.lineitem.dtypes if k in ("bigint", "int", "double")])


@query("f03_value_counts", """
    WITH g AS (SELECT p_name AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(p_name) FROM part), 2) AS pct
               FROM part WHERE p_name IS NOT NULL GROUP BY 1)
    SELECT * FROM (SELECT 'top' AS "end", * FROM g ORDER BY count DESC, value LIMIT 5) UNION ALL
    SELECT * FROM (SELECT 'bottom' AS "end", * FROM g ORDER BY count, value LIMIT 5)""")
def _(t):
    return segments.value_counts(t.part, "p_name", 5)


def shares(table: str, column: str) -> str:
    return (f"SELECT {column} AS v, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, "
            f"row_number() OVER (ORDER BY count(*) DESC, {column}) AS rn, count(*) OVER () AS k "
            f"FROM {table} WHERE {column} IS NOT NULL GROUP BY 1")


def concentration(table: str, column: str, position: int = 0) -> str:
    return f"""
        SELECT '{column}' AS "column", {position} AS position, max(k) AS unique_values, CAST(sum(n) AS BIGINT) AS total_records,
               CASE WHEN max(k) >= 3 THEN round(sum(pct) FILTER (WHERE rn <= 3), 2) ELSE 0 END AS top_3_pct, max(v) FILTER (WHERE rn = 1) AS top_value,
               max(pct) FILTER (WHERE rn = 1) AS top_pct,
               CASE WHEN max(k) < 3 THEN 'Low' WHEN round(sum(pct) FILTER (WHERE rn <= 3), 2) > 70 THEN 'High'
                    WHEN round(sum(pct) FILTER (WHERE rn <= 3), 2) > 40 THEN 'Medium' ELSE 'Low' END AS concentration
        FROM ({shares(table, column)}) HAVING max(k) BETWEEN 2 AND 50"""


@query("f04_concentration", concentration("orders", "o_orderpriority"))
def _(t):
    return segments.concentration(t.orders, "o_orderpriority")


def performers(table: str, column: str, metric: str) -> str:
    return f"""
        SELECT '{column}' AS "column", b.v AS best, round(b.m, 4) AS best_mean, round(b.s, 2) AS best_sum,
               round(100 * b.s / total, 2) AS contribution_pct, w.v AS worst, round(w.m, 4) AS worst_mean, round(w.s, 2) AS worst_sum
        FROM (SELECT {column} AS v, avg({metric}) AS m, sum({metric}) AS s FROM {table} WHERE {column} IS NOT NULL GROUP BY 1
              HAVING count({metric}) > 0 ORDER BY m DESC, v LIMIT 1) b,
             (SELECT {column} AS v, avg({metric}) AS m, sum({metric}) AS s FROM {table} WHERE {column} IS NOT NULL GROUP BY 1
              HAVING count({metric}) > 0 ORDER BY m, v DESC LIMIT 1) w,
             (SELECT sum({metric}) AS total FROM {table} WHERE {column} IS NOT NULL) WHERE total > 0"""


@query("f05_category_metric", performers("part", "p_brand", "p_retailprice"))
def _(t):
    return segments.category_metric(t.part, "p_brand", "p_retailprice")


def analysis(table: str, column: str, position: int, metric: str) -> str:
    return f"""
        SELECT c.*, p.* EXCLUDE ("column"), l.* FROM ({concentration(table, column, position)}) c
        LEFT JOIN ({performers(table, column, metric)}) p ON c."column" = p."column",
        (SELECT (SELECT string_agg(v || ':' || n, ', ' ORDER BY n DESC, v) FROM (SELECT * FROM ({shares(table, column)}) WHERE rn <= 5)) AS top_categories,
                (SELECT string_agg(v || ':' || n, ', ' ORDER BY n, v) FROM (SELECT * FROM ({shares(table, column)}) ORDER BY n, v LIMIT 5)) AS bottom_categories) l"""


@query("f06_category_analysis", over("busy_orders", f"""
    SELECT * FROM ({analysis("busy_orders", "status", 0, "price")}) UNION ALL
    SELECT * FROM ({analysis("busy_orders", "priority", 1, "price")}) UNION ALL
    SELECT * FROM ({analysis("busy_orders", "clerk", 2, "price")})"""))
def _(t):
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ", ")
    df = segments.category_analysis(t.busy_orders, ["status", "priority", "clerk"], "price")
    return df.withColumn("top_categories", listed("top_categories")).withColumn("bottom_categories", listed("bottom_categories"))


def gap(table: str, column: str, position: int, metric: str) -> str:
    return f"""
        SELECT '{column}' AS "column", {position} AS position, arg_min(v, (-m, v)) AS best_segment, round(max(m), 4) AS best_mean,
               arg_max(v, (-m, v)) AS worst_segment, round(min(m), 4) AS worst_mean, count(*) AS segments,
               round(max(m) - min(m), 4) AS performance_gap
        FROM (SELECT {column} AS v, avg({metric}) AS m FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) HAVING count(*) BETWEEN 2 AND 30"""


@query("f07_segment_gap", f"{gap('part', 'p_brand', 0, 'p_retailprice')} UNION ALL {gap('part', 'p_type', 1, 'p_retailprice')} "
                          f"UNION ALL {gap('part', 'p_name', 2, 'p_retailprice')}")
def _(t):
    return segments.segment_gap(t.part, ["p_brand", "p_type", "p_name"], "p_retailprice")


@query("f06_wide", over_wider(" UNION ALL ".join(f"SELECT * FROM ({analysis('wider', c, i, 'l_quantity')})" for i, c in enumerate(WIDE_TEXTS))))
def _(t):
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ", ")
    df = segments.category_analysis(wider(t), WIDE_TEXTS, "l_quantity")
    return df.withColumn("top_categories", listed("top_categories")).withColumn("bottom_categories", listed("bottom_categories"))


@query("f07_wide", over_wider(" UNION ALL ".join(gap("wider", c, i, "l_quantity") for i, c in enumerate(WIDE_TEXTS))))
def _(t):
    return segments.segment_gap(wider(t), WIDE_TEXTS, "l_quantity")


def dominant(table: str, column: str, metric: str) -> str:
    return f"""
        SELECT '{column}' AS "column", v AS category, round(100 * s / total, 2) AS share_pct, round(s, 2) AS top_sum,
               round(total, 2) AS total_sum, 100 * s / total > 40 AS dominant
        FROM (SELECT {column} AS v, {cents(metric)} AS s FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY s DESC, v LIMIT 1),
             (SELECT {cents(metric)} AS total FROM {table} WHERE {column} IS NOT NULL) WHERE total > 0"""


@query("f08_dominant_category", f"{dominant('lineitem', 'l_linestatus', 'l_extendedprice')} UNION ALL "
                                f"{dominant('lineitem', 'l_returnflag', 'l_extendedprice')}")
def _(t):
    return union_all([segments.dominant_category(t.lineitem, c, "l_extendedprice") for c in ("l_linestatus", "l_returnflag")])


@query("f09_diverse_segment", """
    SELECT * FROM (SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS distinct_count FROM part UNION ALL
                   SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)
    WHERE distinct_count BETWEEN 10 AND 100 ORDER BY distinct_count DESC LIMIT 1""")
def _(t):
    names = ["p_name", "p_brand", "p_type"]
    return segments.diverse_segment(quality.distinct_counts(t.part.select(*names)), names)


def kpi_sql(where: str) -> str:
    return f"""
        SELECT 1 AS seq, 'total_records' AS kpi, NULL AS "column", NULL AS label, CAST(count(*) AS DOUBLE) AS value FROM orders {where}
        UNION ALL SELECT 2, 'sum_value', 'o_totalprice', NULL, round({cents('o_totalprice')}, 2) FROM orders {where}
        UNION ALL SELECT 3, 'avg_value', 'o_totalprice', NULL, round(avg(o_totalprice), 2) FROM orders {where}
        UNION ALL SELECT * FROM (SELECT 4, 'top_category', 'o_orderstatus', o_orderstatus, round({cents('o_totalprice')}, 2) AS v
                                 FROM orders {where} GROUP BY o_orderstatus ORDER BY v DESC LIMIT 1)"""


@query("f10_kpis", kpi_sql("WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus ILIKE '%HIGH%' OR o_orderpriority ILIKE '%HIGH%')"))
def _(t):
    orders = t.orders.select(*PRICE_FIRST)
    return segments.kpis(orders, PRICE_FIRST, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "HIGH")


@query("f11_series", f"""
    SELECT o_orderpriority AS label, round({cents('o_totalprice')}, 2) AS value FROM orders WHERE o_orderstatus = 'O'
    GROUP BY 1 ORDER BY value DESC LIMIT 15""")
def _(t):
    return segments.series(t.orders, ORDER_TYPES, "O TotalPrice", "o_orderpriority", {"o_orderstatus": ["O"]}).withColumn(
        "value", F.round("value", 2))


@query("f11_series_fallback", """
    SELECT strftime(o_orderdate, '%Y') AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def _(t):
    return segments.series(t.orders, ORDER_TYPES, None, "none")


@query("f11_series_others", f"""
    WITH g AS (SELECT o_custkey, {cents('o_totalprice')} AS v, row_number() OVER (ORDER BY {cents('o_totalprice')} DESC, o_custkey) AS rn FROM orders GROUP BY 1)
    SELECT CASE WHEN rn <= 15 THEN CAST(o_custkey AS VARCHAR) ELSE 'Others' END AS label, round(sum(v), 2) AS value FROM g GROUP BY 1""")
def _(t):
    return segments.series(t.orders, ORDER_TYPES, "o_totalprice", "o_custkey").withColumn("value", F.round("value", 2))


@query("f12_share_by_category", f"""
    WITH g AS (SELECT p_brand AS label, {cents('p_retailprice')} AS value FROM part GROUP BY 1),
         r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn FROM g)
    SELECT 'bar' AS kind, CASE WHEN rn <= 10 THEN label ELSE 'Others' END AS label, round(sum(value), 2) AS value FROM r GROUP BY 2""")
def _(t):
    return segments.share_by_category(t.part, "p_brand", "p_retailprice").withColumn("value", F.round("value", 2))


@query("f12_share_by_category_pie", over("dirty_customer", """
    SELECT 'pie' AS kind, coalesce(active_flag, 'Null') AS label, sum(mostly_zero) AS value FROM dirty_customer GROUP BY 2"""))
def _(t):
    return segments.share_by_category(t.dirty_customer, "active_flag", "mostly_zero")


@query("f13_frequency_by_category", over("dirty_customer", """
    SELECT CASE WHEN rn <= 15 THEN label ELSE 'Others' END AS label, CAST(sum(n) AS BIGINT) AS count FROM (
      SELECT coalesce(segment, 'Missing') AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(segment, 'Missing')) AS rn
      FROM dirty_customer GROUP BY 1) GROUP BY 1"""))
def _(t):
    return segments.frequency_by_category(t.dirty_customer, "segment")


@query("f14_timeline", f"""
    SELECT strftime(o_orderdate, '%Y') AS label, round({cents('o_totalprice')}, 2) AS value FROM orders GROUP BY 1""")
def _(t):
    return segments.timeline(t.orders, "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


@query("f15_stacked_matrix", """
    SELECT CAST(o_orderdate AS VARCHAR) AS date, """ + ", ".join(
        f"round(coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = '{s}') AS DOUBLE), 0), 2) AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY o_orderdate")
def _(t):
    df = segments.stacked_matrix(t.orders, "o_orderdate", "o_orderstatus", "o_totalprice")
    return df.select("date", *[F.round(c, 2).alias(c) for c in df.columns if c != "date"])


@query("f16_recommend_charts", """
    WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderdate) AS d, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p,
                      count(DISTINCT (o_orderdate, o_orderstatus)) AS cells FROM orders WHERE o_orderstatus IN ('F', 'O')),
         c AS (SELECT 1 AS o, 'line' AS type, 'o_orderdate' AS x_column, 'o_orderkey' AS y_column FROM n WHERE d > 1 UNION ALL
               SELECT 2, CASE WHEN s <= 6 THEN 'pie' ELSE 'bar' END, 'o_orderstatus', 'o_orderkey' FROM n WHERE s > 1 UNION ALL
               SELECT 3, CASE WHEN p <= 6 THEN 'pie' ELSE 'bar' END, 'o_orderpriority', 'o_orderkey' FROM n WHERE p > 1 UNION ALL
               SELECT 4, 'scatter', 'o_orderkey', 'o_custkey' FROM n WHERE n > 5 UNION ALL
               SELECT 5, 'area', 'o_orderdate', 'o_orderkey' FROM n WHERE s BETWEEN 2 AND 5 AND cells > 4)
    SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS idx, type, x_column, y_column FROM c""")
def _(t):
    return segments.recommend_charts(t.orders, ORDER_TYPES, {"o_orderstatus": ["F", "O"]})


@query("f17_cross_filter", kpi_sql("WHERE o_orderstatus = 'F'"))
def _(t):
    clicked = filters.cross_filter({"o_orderpriority": ["1-URGENT"]}, "o_orderstatus", "F")
    return segments.kpis(t.orders.select(*PRICE_FIRST), PRICE_FIRST, filters.cross_filter(clicked, "o_orderpriority"))


F18_WHERE = "WHERE o_orderstatus = 'F' AND (o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%')"


@query("f18_dashboard", f"""
    SELECT 'kpi' AS part, kpi AS a, coalesce("column", '') || coalesce(label, '') AS b, value FROM ({kpi_sql(F18_WHERE)}) UNION ALL
    SELECT 'chart', 'line', 'o_orderdate o_totalprice', 1 UNION ALL SELECT 'chart', 'pie', 'o_orderpriority o_totalprice', 2 UNION ALL
    SELECT 'chart', 'scatter', 'o_totalprice o_orderkey', 3 UNION ALL
    SELECT 'line', strftime(o_orderdate, '%Y'), '', round({cents('o_totalprice')}, 2) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL
    SELECT 'pie', o_orderpriority, '', round({cents('o_totalprice')}, 2) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL
    SELECT 'table', '', '', o_orderkey FROM (SELECT o_orderkey FROM orders {F18_WHERE} ORDER BY o_orderkey LIMIT 20) UNION ALL
    SELECT 'total', '', '', count(*) FROM orders {F18_WHERE}""")
def _(t):
    orders, types = t.orders.select("o_totalprice", "o_orderkey", *list(PRICE_FIRST)[1:]), ORDER_TYPES
    d = segments.dashboard(orders, types, ["o_orderkey"], {"o_orderstatus": ["F"]}, "urgent")
    # one value of the status is left, so it gets no chart of its own and no area
    part = lambda frame, name, a, b, v: frame.select(
        F.lit(name).alias("part"), a.cast("string").alias("a"), b.cast("string").alias("b"), F.round(v.cast("double"), 2).alias("value"))
    none = F.lit("")
    return union_all([
        part(d["kpis"], "kpi", F.col("kpi"), F.concat(F.coalesce("column", none), F.coalesce("label", none)), F.col("value")),
        part(d["charts"], "chart", F.col("type"), F.concat_ws(" ", "x_column", "y_column"), F.col("idx")),
        part(d["chart_data"][1], "line", F.col("label"), none, F.col("value")), part(d["chart_data"][2], "pie", F.col("label"), none, F.col("value")),
        part(d["table"], "table", none, none, F.col("o_orderkey")), part(d["total"], "total", none, none, F.col("total_count"))])
