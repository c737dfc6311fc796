from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.registry import each, query
from tabulight.operators import schema
from tabulight.plans.profile import literal_rows
from tabulight.session import new_folder
from tabulight.sources import writers, cleaning, delimited

CUSTOMER = ["c_custkey", "segment", "acctbal", "mixed_code", "active_flag", "mostly_zero", "const_col", "empty_col",
            "c_nationkey"]
ORDERS = ["o_orderkey", "order_day", "price_text", "o_orderstatus", "o_orderpriority"]
RAW_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

DATE_LIST = [f"'{f}'" for f in (
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y%m%d", "%d %b %Y", "%B %d, %Y", "%b %d, %Y")]
DATES = ", ".join(DATE_LIST)
FLAGS = "'true','false','yes','no','y','n','t','f','1','0','on','off','enabled','disabled'"


def as_text(table: str, names: list[str]) -> str:
    return each(names, f"SELECT '{{c}}' AS \"column\", {{i}} AS position, typeof({{c}}) AS native, "
                       f"CAST({{c}} AS VARCHAR) AS v FROM {table}")


def types_sql(table: str, names: list[str]) -> str:
    """Semantic types by the rules, from the text form of every value."""
    one_format = ", ".join(f"count(try_strptime(v, {f}))" for f in DATE_LIST)
    return f"""
        SELECT "column", position, CASE
            WHEN d IN (2, 3) AND flags THEN 'BOOL'
            WHEN native IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'NUM'
            WHEN native LIKE 'TIMESTAMP%' THEN 'DATE'
            WHEN n = 0 THEN 'TEXT'
            WHEN num >= 0.9 * n THEN 'NUM'
            WHEN dates >= 0.8 * n THEN 'DATE'
            WHEN n >= 5 AND num >= 0.2 * n THEN 'MIXED' ELSE 'TEXT' END AS type
        FROM (SELECT "column", position, any_value(native) AS native, count(v) AS n, count(DISTINCT v) AS d,
                     bool_and(lower(trim(v)) IN ({FLAGS})) AS flags, count(TRY_CAST(v AS DOUBLE)) AS num,
                     greatest({one_format}) AS dates
              FROM ({as_text(table, names)}) GROUP BY 1, 2)"""


@query("a01_read_delimited", over("dirty_orders", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, order_day, price_text, o_orderstatus, o_orderpriority
    FROM dirty_orders"""))
def _(t):
    path = new_folder(t.spark, "semicolon")
    t.dirty_orders.write.option("header", True).option("sep", ";").csv(path)
    return delimited.read_delimited(t.spark, path, "txt")


@query("a01_quoted", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def _(t):
    path = new_folder(t.spark, "quoted")
    writers.write_csv(t.documents, path)
    return delimited.read_delimited(t.spark, path)


@query("a01_multi_file", """
    SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, NULL AS p FROM orders UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority FROM orders""")
def _(t):
    path = new_folder(t.spark, "several")
    t.orders.selectExpr("o_orderkey as k", "o_orderstatus as s").write.option("header", True).csv(path)
    t.orders.selectExpr("o_orderpriority as p", "o_orderstatus as s", "o_orderkey as k").write.mode("append").option("header", True).option("sep", ";").csv(path)
    return delimited.read_delimited(t.spark, path).select("k", "s", "p")


LONG_LINES = "CASE WHEN o_orderkey % 10 = 0 THEN concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',more') ELSE concat(CAST(o_orderkey AS STRING), ',\"', o_orderstatus, ',x\"') END"


@query("a01_rejected", f"SELECT 'rejected' AS what, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'read', count(*) FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    path = new_folder(t.spark, "long")
    lines = t.orders.selectExpr(f"{LONG_LINES} as `k,s`")                              # each file has the header; nothing is quoted or parted again
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(path)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(delimited.rejected_lines(t.spark, path), "rejected").unionByName(count(delimited.read_delimited(t.spark, path), "read"))


@query("a02_sniff_delimiter", """
    SELECT name AS name, sep AS separator
    FROM (VALUES ('comma', ','), ('pipe', '|'), ('semicolon', ';'), ('tab', chr(9))) AS v(name, sep)""")
def _(t):
    found = []
    for name, sep in {"comma": ",", "pipe": "|", "semicolon": ";", "tab": "\t"}.items():
        path = new_folder(t.spark, name)
        t.orders.write.option("header", True).option("sep", sep).csv(path)
        found.append((name, delimited.sniff_delimiter(t.spark, path)))
    return literal_rows(t.orders, found, "name string, separator string")


@query("a03_detect_encoding", "SELECT 'latin' AS name, 'ISO-8859-1' AS encoding UNION ALL SELECT 'utf', 'UTF-8'")
def _(t):
    text = t.documents.select(F.regexp_replace("text", "\\s+", " ").alias("text"))
    frames = []
    for name, charset in (("utf", "UTF-8"), ("latin", "ISO-8859-1")):
        path = new_folder(t.spark, name)
        text.write.option("encoding", charset).csv(path)
        frames.append(delimited.detect_encoding(t.spark, path).select(F.lit(name).alias("name"), "encoding").distinct())
    return frames[0].unionByName(frames[1])


@query("a04_null_sentinels", over("dirty_customer", """
    SELECT * REPLACE (CASE WHEN segment = 'N/A' THEN NULL ELSE segment END AS segment) FROM dirty_customer"""))
def _(t):
    return cleaning.null_sentinels(t.dirty_customer)


@query("a05_clean_table", over("dirty_orders", """
    SELECT o_orderkey AS "Order_Key", order_day, CAST(price_text AS DOUBLE) AS price_text,
           o_orderstatus AS column_3, o_orderpriority AS "Order_Day_1" FROM dirty_orders"""))
def _(t):
    raw = t.dirty_orders.withColumn("o_orderpriority", F.concat(F.lit(" "), "o_orderpriority", F.lit("\t"))).toDF(
        " Order  Key $", "order day", "price (text)", "", "Order_Day")
    return cleaning.clean_table(raw)


@query("a06_drop_empty", over("dirty_customer", """
    SELECT * EXCLUDE (empty_col) FROM dirty_customer"""))
def _(t):
    return cleaning.drop_empty(t.dirty_customer)


@query("a07_coerce_numeric", over("dirty_orders", """
    SELECT * REPLACE (CAST(price_text AS DOUBLE) AS price_text) FROM dirty_orders"""))
def _(t):
    return cleaning.coerce_numeric(t.dirty_orders)


@query("a08_strip_strings", over("dirty_customer", """
    SELECT * REPLACE (nullif(trim(segment), '') AS segment) FROM dirty_customer"""))
def _(t):
    return cleaning.strip_strings(t.dirty_customer)


def classes_sql(table: str, names: list[str]) -> str:
    return f"""
        SELECT "column", position, CASE
            WHEN num >= greatest(10, floor(0.3 * n)) THEN 'numeric'
            WHEN dates >= greatest(10, floor(0.3 * n)) THEN 'date' ELSE 'categorical' END AS class
        FROM (SELECT "column", position, count(*) AS n, count(TRY_CAST(v AS DOUBLE)) AS num,
                     count(try_strptime(v, [{DATES}])) AS dates
              FROM ({as_text(table, names)}) GROUP BY 1, 2)"""


@query("a09_classify_columns", over("dirty_customer", classes_sql("dirty_customer", CUSTOMER)))
def _(t):
    return schema.classify_columns(t.dirty_customer)


@query("a09_classify_columns_dates", over("dirty_orders", classes_sql("dirty_orders", ORDERS)))
def _(t):
    return schema.classify_columns(t.dirty_orders)


@query("a10_detect_schema", over("dirty_customer", types_sql("dirty_customer", CUSTOMER)))
def _(t):
    return schema.detect_schema(t.dirty_customer)


@query("a10_detect_schema_dates", over("dirty_orders", types_sql("dirty_orders", ORDERS)))
def _(t):
    return schema.detect_schema(t.dirty_orders)


@query("a10_detect_schema_flags", types_sql("labels", ["doc_id", "quality", "toxic"]))
def _(t):
    return schema.detect_schema(t.labels)


@query("a11_schema_diff", over("dirty_orders", f"""
    SELECT coalesce(a."column", b."column") AS "column", coalesce(a.type, 'MISSING') AS type_a,
           coalesce(b.type, 'MISSING') AS type_b
    FROM ({types_sql("dirty_orders", ORDERS)}) a FULL JOIN ({types_sql("orders", RAW_ORDERS)}) b
      ON a."column" = b."column" WHERE a.type IS DISTINCT FROM b.type"""))
def _(t):
    return schema.schema_diff(schema.detect_schema(t.dirty_orders), schema.detect_schema(t.orders))


@query("a10_detect_schema_iso", """
    SELECT 'event_id' AS "column", 'NUM' AS type, 0 AS position UNION ALL SELECT 'at', 'DATE', 1 UNION ALL SELECT 'value', 'NUM', 2""")
def _(t):
    return schema.detect_schema(t.events.selectExpr("event_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") || 'Z' as at", "value"))


@query("a12_sample_rows", """
    SELECT * FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 500""")
def _(t):
    return schema.sample_rows(t.orders, 500, ["o_orderkey"])
