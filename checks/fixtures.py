"""Test tables: the given ones, and versions of them with known dirt.

The given tables hold no NULLs, no duplicates and no mixed types, so the quality operators
run on the derived tables below. Their SQL is read by both engines; the remainders only decide
which rows get which kind of dirt, every row of the source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DERIVED = {
    "dirty_customer": """
        WITH d AS (
          SELECT c_custkey,
            CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '  '
                 WHEN c_custkey % 17 = 0 THEN 'N/A' WHEN c_custkey % 19 = 0 THEN concat(' ', c_mktsegment, ' ')
                 ELSE c_mktsegment END AS segment,
            CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
            CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE CAST(c_custkey AS STRING) END AS mixed_code,
            CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS active_flag,
            CAST(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 0
                      ELSE c_custkey END AS DOUBLE) AS mostly_zero,
            'same' AS const_col, CAST(NULL AS STRING) AS empty_col, c_nationkey
          FROM {customer})
        SELECT * FROM d UNION ALL SELECT * FROM d WHERE c_custkey % 10 = 0""",
    "dirty_orders": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 20 = 0 THEN 'not a date'
               ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS order_day,
          CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price_text,
          o_orderstatus, o_orderpriority
        FROM {orders}""",
    "wide_lineitem": """
        SELECT *, l_extendedprice * (1 - l_discount) AS net_price, -1 * l_extendedprice AS neg_price
        FROM {lineitem}""",
    # metric, dates and categories with spikes, gaps and a mirrored column
    "busy_orders": """
        SELECT o_orderkey AS order_no, o_orderdate AS ordered_on,
          CASE WHEN o_orderkey % 50 = 0 THEN NULL
               WHEN year(o_orderdate) = 1999 AND month(o_orderdate) = 6 THEN o_totalprice * 3
               WHEN year(o_orderdate) = 1998 AND month(o_orderdate) = 2 THEN o_totalprice / 4
               ELSE o_totalprice END AS price,
          -o_totalprice AS refund, o_orderstatus AS status, o_orderpriority AS priority,
          concat('clerk ', CAST(o_custkey % 40 AS STRING)) AS clerk
        FROM {orders}""",
    # text with broken characters, placeholders and numbers in between
    "noisy_documents": """
        SELECT doc_id,
          CASE WHEN doc_id % 7 = 0 THEN concat(text, '�') WHEN doc_id % 11 = 0 THEN concat(text, chr(7))
               WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text,
          CASE WHEN doc_id % 6 = 0 THEN concat(lang, ' ') ELSE lang END AS lang,
          CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS STRING) ELSE source END AS source, n_chars
        FROM {documents}""",
    # the text of every turn, and for each user turn a question about data as well
    "questions": """
        SELECT conv_id, turn, text FROM {conversations} UNION ALL
        SELECT conv_id, turn + 1000000 AS turn, CASE (conv_id * 7 + turn) % 12
            WHEN 0 THEN 'How many orders are there in total?'
            WHEN 1 THEN concat('Show top ', CAST(turn + 3 AS STRING), ' orders by o_totalprice')
            WHEN 2 THEN 'Plot a line chart of o_totalprice per month'
            WHEN 3 THEN 'Which o_orderpriority has the Highest average price?'
            WHEN 4 THEN 'Tell me a joke about the weather'
            WHEN 5 THEN 'Describe the schema, please'
            WHEN 6 THEN 'Find duplicated rows'
            WHEN 7 THEN 'unique o_orderstatus values'
            WHEN 8 THEN 'smallest o_custkey!'
            WHEN 9 THEN 'next page'
            WHEN 10 THEN 'priority status custkey'
            ELSE 'mean, avg or Total of twenty one items?' END AS text
        FROM {conversations} WHERE role = 'user'""",
}

SOURCES = {
    "dirty_customer": "customer", "dirty_orders": "orders", "wide_lineitem": "lineitem",
    "busy_orders": "orders", "noisy_documents": "documents", "questions": "conversations",
}


class Tables:
    """The tables of one scale; ``t.orders`` is the given table, ``t.dirty_orders`` a derived one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            source = SOURCES[name]
            return self.spark.sql(DERIVED[name], **{source: getattr(self, source)})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def over(name: str, rest: str) -> str:
    """SQL over a derived table; ``rest`` is a SELECT or more CTEs starting with a comma."""
    return f"WITH {name} AS ({DERIVED[name].replace('{' + SOURCES[name] + '}', SOURCES[name])}) {rest}"
