from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.quality import TYPES
from checks.registry import query
from tabulight.operators import repair

GAP = "(segment IS NULL OR trim(segment) = '' OR segment IN ('nan', 'undefined', 'None'))"
MODE = f"(SELECT segment FROM dirty_customer WHERE NOT {GAP} GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)"


def c(sql: str) -> str:
    return over("dirty_customer", sql)


@query("i01_missing_detail", c("""
    SELECT 'acctbal' AS "column", count(*) AS total_rows, count(*) - count(acctbal) AS missing_count, round(avg(acctbal), 2) AS mean,
           round(quantile_cont(acctbal, 0.5), 2) AS median,
           (SELECT round(acctbal, 2) FROM dirty_customer WHERE acctbal IS NOT NULL GROUP BY acctbal ORDER BY count(*) DESC, acctbal LIMIT 1) AS mode
    FROM dirty_customer"""))
def _(t):
    return repair.missing_detail(t.dirty_customer, "acctbal", TYPES).withColumn("mode", F.col("mode").cast("double"))


@query("i01_missing_detail_text", c(f"""
    SELECT 'segment' AS "column", count(*) AS total_rows, count(*) FILTER (WHERE {GAP}) AS missing_count, CAST(NULL AS DOUBLE) AS mean,
           CAST(NULL AS DOUBLE) AS median, {MODE} AS mode FROM dirty_customer"""))
def _(t):
    return repair.missing_detail(t.dirty_customer, "segment", TYPES)


@query("i01_missing_preview", c(f"""
    SELECT c_custkey, mixed_code, CASE WHEN NOT {GAP} THEN segment END AS value, {GAP} AS is_missing FROM dirty_customer
    ORDER BY c_custkey LIMIT 100"""))
def _(t):
    return repair.missing_preview(t.dirty_customer, "segment", ["c_custkey", "mixed_code"])


FILLED = f"SELECT * REPLACE (CASE WHEN {GAP} THEN {MODE} ELSE segment END AS segment), {GAP} AS was_missing, CASE WHEN {GAP} THEN segment END AS old_value FROM dirty_customer"


@query("i02_fill_missing_mode", c(FILLED))
def _(t):
    return repair.fill_missing(t.dirty_customer, "segment", "mode", schema=TYPES)


def filled(value: str) -> str:
    return c(f"""SELECT * REPLACE (coalesce(acctbal, {value}) AS acctbal), acctbal IS NULL AS was_missing, CAST(NULL AS DOUBLE) AS old_value FROM dirty_customer""")


@query("i02_fill_missing_mean", filled("(SELECT round(avg(acctbal), 2) FROM dirty_customer)"))
def _(t):
    return repair.fill_missing(t.dirty_customer, "acctbal", "mean", schema=TYPES)


@query("i02_fill_missing_median", filled("(SELECT round(quantile_cont(acctbal, 0.5), 2) FROM dirty_customer)"))
def _(t):
    return repair.fill_missing(t.dirty_customer, "acctbal", "median", schema=TYPES)


@query("i02_fill_missing_custom", filled("-1.5"))
def _(t):
    return repair.fill_missing(t.dirty_customer, "acctbal", "custom", "-1.5", TYPES)


@query("i03_fill_preview", c(f"""
    SELECT c_custkey, coalesce(segment, '[EMPTY]') AS old, {MODE} AS new, (SELECT count(*) FROM dirty_customer WHERE {GAP}) AS affected_rows
    FROM dirty_customer WHERE {GAP} ORDER BY c_custkey, old LIMIT 50"""))
def _(t):
    return repair.fill_preview(t.dirty_customer, "segment", "mode", ["c_custkey"], schema=TYPES)


@query("i04_fill_summary", c("""
    SELECT "column", data_type, missing_count, total_rows, CAST(sum(missing_count) OVER () AS BIGINT) AS total_missing FROM (
      SELECT 'acctbal' AS "column", 'Numeric' AS data_type, count(*) - count(acctbal) AS missing_count, count(*) AS total_rows FROM dirty_customer
      UNION ALL SELECT 'empty_col', 'Categorical', count(*) - count(empty_col), count(*) FROM dirty_customer) WHERE missing_count > 0"""))
def _(t):
    return repair.fill_summary(t.dirty_customer, "segment", "mode", TYPES)


@query("i05_undo_fill", over("busy_orders", "SELECT order_no, price, status FROM busy_orders"))
def _(t):
    original = t.busy_orders.select("order_no", "price", "status")
    filled_table = repair.fill_missing(original, "price", "mean", schema={"price": "NUM"})
    return repair.undo_fill(filled_table, "price")


@query("i05_undo_repeated_keys", over("dirty_customer", """
    SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 20 END AS k, segment, acctbal FROM dirty_customer"""))
def _(t):
    table = t.dirty_customer.selectExpr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 20 END AS k", "segment", "acctbal")
    return repair.undo_fill(repair.fill_missing(table, "segment", "mode", schema={"segment": "TEXT"}), "segment")
