from __future__ import annotations

from pyspark.sql import functions as F

from checks.quality import TYPES, c
from checks.registry import query
from tabulight.operators.repair import fill_missing
from tabulight.session import new_folder
from tabulight.sources import writers

ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
ORDER_TYPES = {"o_orderkey": "NUM", "o_custkey": "NUM", "o_orderstatus": "TEXT", "o_totalprice": "NUM", "o_orderdate": "DATE",
               "o_orderpriority": "TEXT"}


@query("k01_write_csv", "SELECT * FROM orders")
def _(t):
    path = new_folder(t.spark, "csv")
    writers.write_csv(t.orders, path)
    return t.spark.read.schema(ORDERS).csv(path, header=True)


@query("k02_write_json", """
    SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def _(t):
    path = new_folder(t.spark, "json")
    writers.write_json(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                                         "c_mktsegment"), path)
    return t.spark.read.schema("c_custkey BIGINT, c_acctbal DOUBLE, c_mktsegment STRING").json(path)


@query("k03_export_filtered", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority ILIKE '%low%' OR o_orderstatus ILIKE '%low%')")
def _(t):
    path = new_folder(t.spark, "filtered")
    writers.export_filtered(t.orders, path, ORDER_TYPES, {"o_orderstatus": "F"}, "low", "o_totalprice", "DESC")
    return t.spark.read.schema(ORDERS).csv(path, header=True)


def _cleaned(fmt: str) -> None:
    @query(f"k04_export_cleaned_{fmt}", c("SELECT c_custkey, coalesce(acctbal, 7) AS acctbal, mixed_code FROM dirty_customer"))
    def _(t):
        path = new_folder(t.spark, fmt)
        writers.export_cleaned(fill_missing(t.dirty_customer.select("c_custkey", "acctbal", "mixed_code"), "acctbal", "custom", 7, TYPES), path, fmt)
        reader = t.spark.read.schema("c_custkey BIGINT, acctbal DOUBLE, mixed_code STRING").option("header", True)
        return reader.format(fmt).load(path)


for _fmt in ("csv", "json", "parquet"):
    _cleaned(_fmt)
