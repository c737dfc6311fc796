from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.registry import query
from tabulight.functions.columns import is_missing
from tabulight.operators import filters

DOCUMENT_TYPES = {"doc_id": "NUM", "text": "TEXT", "lang": "TEXT", "source": "TEXT", "n_chars": "NUM"}


@query("b01_filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return filters.filter_eq(t.orders, "o_orderstatus", "F")


@query("b02_filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(t):
    return filters.filter_in(t.orders, "o_orderpriority", ["1-URGENT", None, "", "5-LOW", "None"])


@query("b03_filter_range", "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def _(t):
    return filters.filter_range(t.orders, "o_totalprice", 100000, 200000)


@query("b04_apply_filters", """
    SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 250000
      AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'""")
def _(t):
    return filters.apply_filters(t.orders, {
        "O OrderStatus": ["F", "O"], "o_totalprice": {"start": 250000, "end": ""},
        "o_orderdate": {"start": "1996-01-01", "end": "1999-12-31"}, "no such column": "x", "o_orderpriority": "none"})


@query("b05_search_text", """
    SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%LICENSE%' OR lang ILIKE '%LICENSE%' OR source ILIKE '%LICENSE%'""")
def _(t):
    return filters.search_text(t.documents, "LICENSE", DOCUMENT_TYPES).select("doc_id", "lang", "source")


@query("b06_keyword_search", """
    SELECT doc_id, lang, source FROM documents d
    WHERE CASE WHEN (SELECT bool_or(contains(lower(source), 'zzqy')) FROM documents) THEN contains(lower(source), 'zzqy')
               WHEN (SELECT bool_or(contains(lower(text), 'zzqy')) FROM documents) THEN contains(lower(text), 'zzqy')
               WHEN (SELECT bool_or(contains(lower(source), 'license')) FROM documents) THEN contains(lower(source), 'license')
               WHEN (SELECT bool_or(contains(lower(text), 'license')) FROM documents) THEN contains(lower(text), 'license')
               ELSE false END""")
def _(t):
    return filters.keyword_search(t.documents, "is ZZQY or license", ["source", "text"]).select("doc_id", "lang", "source")


@query("b07_is_missing", over("dirty_customer", """
    SELECT c_custkey, segment IS NULL AS m0, coalesce(trim(segment), '') = '' AS m1,
           coalesce(trim(segment), '') = '' OR segment IN ('nan', 'undefined') AS m2,
           regexp_replace(lower(coalesce(segment, '')), '^\\s+|\\s+$', '', 'g') IN ('', 'null', 'none', 'nan', 'n/a', 'na',
             'undefined', '-', '--', '?', 'n/a.', 'n.d.', 'nd', '#n/a', '#na') AS m3
    FROM dirty_customer"""))
def _(t):
    df = t.dirty_customer
    return df.select("c_custkey", *[is_missing(df, "segment", m).alias(m.lower()) for m in ("M0", "M1", "M2", "M3")])


@query("b08_project", "SELECT l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _(t):
    return filters.project(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_shipdate"])


@query("b09_json_safe", """
    SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def _(t):
    balance = (F.when(F.col("c_custkey") % 9 == 0, float("nan")).when(F.col("c_custkey") % 20 == 0, float("inf"))
               .when(F.col("c_custkey") % 10 == 0, float("-inf")).otherwise(F.col("c_acctbal")))
    return filters.json_safe(t.customer.select("c_custkey", balance.alias("balance")))


USER_SQL = {
    "select": ("orders", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM dataset WHERE o_totalprice > 300000"),
    "group": ("orders", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM dataset
                GROUP BY o_orderpriority HAVING count(*) > 10"""),
    "order": ("orders", "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "distinct": ("part", "SELECT DISTINCT p_brand, p_type FROM dataset"),
    "cte": ("orders", """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM dataset GROUP BY o_custkey)
                SELECT o_custkey, top, CASE WHEN top > 400000 THEN 'big' ELSE 'small' END AS size FROM big
                WHERE top > (SELECT avg(o_totalprice) FROM dataset)"""),
    "sets": ("orders", """SELECT o_custkey FROM dataset WHERE o_orderstatus = 'F' INTERSECT
                SELECT o_custkey FROM dataset WHERE o_orderstatus = 'O' EXCEPT
                SELECT o_custkey FROM dataset WHERE o_orderpriority = '1-URGENT'"""),
    "window": ("orders", """SELECT o_orderkey, o_custkey, CAST(row_number() OVER (
                PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM dataset"""),
    "self_join": ("nation", """SELECT a.n_name AS first_name, b.n_name AS second_name FROM dataset a
                JOIN dataset b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""),
}


def _register(name: str, table: str, sql: str) -> None:
    @query(f"b10_sql_{name}", sql.replace("dataset", table))
    def _(t):
        return filters.sql_readonly(t.spark, "Sure, here it is:\n```sql\n" + sql + "\n```", dataset=getattr(t, table))


for _name, (_table, _sql) in USER_SQL.items():
    _register(_name, _table, _sql)
