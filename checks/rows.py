from __future__ import annotations

from checks.fixtures import over
from checks.registry import each, query
from tabulight.operators import rows

TYPES = {"o_orderkey": "NUM", "o_custkey": "NUM", "o_orderstatus": "TEXT", "o_totalprice": "NUM",
         "o_orderdate": "DATE", "o_orderpriority": "TEXT"}


@query("c01_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t):
    return rows.head(t.orders, 50, ["o_orderkey"])


@query("c02_top_n", over("dirty_customer", """
    SELECT c_custkey, acctbal FROM dirty_customer WHERE acctbal IS NOT NULL ORDER BY acctbal DESC, c_custkey LIMIT 10"""))
def _(t):
    return rows.top_n(t.dirty_customer, "acctbal", 10, ["c_custkey"]).select("c_custkey", "acctbal")


@query("c02_bottom_n", over("dirty_customer", """
    SELECT c_custkey, acctbal FROM dirty_customer WHERE acctbal IS NOT NULL ORDER BY acctbal, c_custkey LIMIT 10"""))
def _(t):
    return rows.bottom_n(t.dirty_customer, "acctbal", 10, ["c_custkey"]).select("c_custkey", "acctbal")


@query("c03_top_bottom_summary", """
    SELECT 'o_totalprice' AS metric, round(t, 4) AS top_mean, round(b, 4) AS bottom_mean, round(t - b, 4) AS gap
    FROM (SELECT (SELECT avg(p) FROM (SELECT o_totalprice AS p FROM orders ORDER BY p DESC LIMIT 10)) AS t,
                 (SELECT avg(p) FROM (SELECT o_totalprice AS p FROM orders ORDER BY p LIMIT 10)) AS b)""")
def _(t):
    return rows.top_bottom_summary(t.orders, "o_totalprice")


@query("c04_sort_by", over("dirty_customer", "SELECT c_custkey, segment FROM dirty_customer ORDER BY segment ASC NULLS FIRST, c_custkey"))
def _(t):
    return rows.sort_by(t.dirty_customer, "segment", "sideways", ["c_custkey"]).select("c_custkey", "segment")


@query("c05_page", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return rows.page(t.orders, 3, 20, "o_totalprice", "DESC", ["o_orderkey"])


@query("c05_page_deep", "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity FROM lineitem "
       "ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 50 OFFSET 30000")
def _(t):
    return rows.page(t.lineitem, 601, 50, "l_shipdate", "DESC", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity")


@query("c05_page_deep_nulls", over("dirty_customer", """
    SELECT segment, c_custkey FROM dirty_customer ORDER BY segment DESC NULLS LAST, c_custkey NULLS FIRST LIMIT 40 OFFSET 160"""))
def _(t):
    return rows.page(t.dirty_customer, 5, 40, "segment", "DESC", ["c_custkey"]).select("segment", "c_custkey")


@query("c06_drill_table", """
    WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND (o_orderstatus ILIKE '%urgent%' OR o_orderpriority ILIKE '%urgent%'))
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM m) AS total_count FROM m
    ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 20""")
def _(t):
    table, total = rows.drill_table(t.orders, TYPES, {"o_orderstatus": "F"}, "urgent", "o_totalprice", "ASC", 2, 20, ["o_orderkey"])
    return table.select("o_orderkey", "o_totalprice", total.scalar().alias("total_count"))


@query("c07_distinct_values", over("dirty_customer", "SELECT DISTINCT segment FROM dirty_customer WHERE segment IS NOT NULL"))
def _(t):
    return rows.distinct_values(t.dirty_customer, rows.named_column("unique segment values", ["segment", "mixed_code"], ["mixed_code"]))


@query("c08_sample_values", each(["doc_id", "text", "lang", "source", "n_chars"], """
    SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS rank,
           CASE WHEN length(CAST({c} AS VARCHAR)) > 100 THEN concat(substr(CAST({c} AS VARCHAR), 1, 100), '...')
                ELSE CAST({c} AS VARCHAR) END AS sample
    FROM (SELECT DISTINCT {c} FROM documents WHERE {c} IS NOT NULL) QUALIFY rank <= 3"""))
def _(t):
    return rows.sample_values(t.documents)


@query("c09_duplicate_rows", over("dirty_customer", """
    SELECT * FROM dirty_customer
    QUALIFY count(*) OVER (PARTITION BY c_custkey, segment, acctbal, mixed_code, active_flag, mostly_zero, const_col,
                           empty_col, c_nationkey) > 1"""))
def _(t):
    return rows.duplicate_rows(t.dirty_customer)


NAN = """SELECT c_custkey % 50 AS k, CASE WHEN c_custkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 3 = 1 THEN NULL ELSE 1 END AS v FROM {customer}"""


@query("c09_nan", f"""
    SELECT k, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM ({NAN.replace('{customer}', 'customer')})
    QUALIFY count(*) OVER (PARTITION BY k, CASE WHEN isnan(v) THEN NULL ELSE v END) > 1""")
def _(t):
    return rows.duplicate_rows(t.spark.sql(NAN, customer=t.customer))


@query("c10_scatter_points", over("dirty_customer", """
    SELECT acctbal AS x, mostly_zero AS y FROM dirty_customer WHERE acctbal IS NOT NULL AND mostly_zero IS NOT NULL
    ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey, acctbal, mostly_zero LIMIT 300"""))
def _(t):
    return rows.scatter_points(t.dirty_customer, "acctbal", "mostly_zero", ["c_custkey"])
