from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.registry import each, query
from tabulight.operators import stats

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE = LINE + ["net_price", "neg_price"]

SUMMARY = """
    SELECT '{c}' AS "column", {i} AS position, n AS count, round(mean, 4) AS mean, round(median, 4) AS median,
           (SELECT round(CAST({c} AS DOUBLE), 4) FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
           round(std, 4) AS std, round(var, 4) AS variance, CAST(lo AS DOUBLE) AS "min", CAST(hi AS DOUBLE) AS "max",
           round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
           CASE WHEN mean > median THEN 'Right-skewed (positive skew)' WHEN mean < median THEN 'Left-skewed (negative skew)' ELSE 'Normal' END AS skewness,
           CASE WHEN mean <> 0 AND std / mean > 0.5 THEN 'High' WHEN mean <> 0 AND std / mean > 0.2 THEN 'Medium' ELSE 'Low' END AS variability
    FROM (SELECT count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS var, min({c}) AS lo, max({c}) AS hi,
                 quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
                 quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)"""


@query("g01_stat_summary", each(LINE, SUMMARY))
def _(t):
    return stats.stat_summary(t.lineitem, LINE)


#: Twenty numbers, three dates and eight texts of one table.
WIDE_NUMBERS = LINE + [f"n{i}" for i in range(12)]
WIDE_DATES, WIDE_TEXTS = ["l_shipdate", "d1", "d2"], ["l_returnflag", "l_linestatus"] + [f"t{i}" for i in range(6)]
MADE = ", ".join(
    [f"l_partkey * {i + 1} + CAST(l_quantity AS BIGINT) * l_linenumber * {37 * (i % 5)} AS n{i}" for i in range(12)]
    + ["l_shipdate + INTERVAL 40 DAYS AS d1", "l_shipdate + INTERVAL 400 DAYS AS d2"]
    + [f"CASE WHEN l_quantity > {4 + 7 * i} THEN l_returnflag ELSE concat(l_linestatus, CAST(l_linenumber AS STRING)) END AS t{i}" for i in range(6)])
WIDER = f"SELECT *, {MADE} FROM {{lineitem}}"


def wider(t):
    return t.spark.sql(WIDER, lineitem=t.lineitem)


def over_wider(sql: str) -> str:
    return f"WITH wider AS ({WIDER.replace('{lineitem}', 'lineitem')}) {sql}"


@query("g01_wide", over_wider(f"""SELECT * EXCLUDE (position) REPLACE (round(variance, -4) AS variance) FROM ({each(WIDE_NUMBERS, SUMMARY.replace("lineitem", "wider"))})"""))
def _(t):
    return stats.stat_summary(wider(t), WIDE_NUMBERS).drop("position").withColumn("variance", F.round("variance", -4))


@query("g02_notable_stats", f"""
    WITH s AS ({each(LINE, SUMMARY)})
    SELECT "column", 'high variability' AS note FROM s WHERE variability = 'High' UNION ALL
    SELECT "column", skewness FROM s WHERE skewness <> 'Normal'""")
def _(t):
    return stats.notable_stats(stats.stat_summary(t.lineitem, LINE))


def outliers(table: str, min_count: int, zero_iqr: bool = True) -> str:
    return f"""
        SELECT '{{c}}' AS "column", n, lo_n AS low_outliers, hi_n AS high_outliers, lo_n + hi_n AS total_outliers,
               round(100.0 * (lo_n + hi_n) / n, 2) AS outlier_pct, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q1, q3, min_outlier, max_outlier
        FROM (SELECT count({{c}}) AS n, any_value(q1) AS q1, any_value(q3) AS q3,
                     count(*) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1)) AS lo_n, count(*) FILTER (WHERE {{c}} > q3 + 1.5 * (q3 - q1)) AS hi_n,
                     min({{c}}) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS min_outlier,
                     max({{c}}) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS max_outlier
              FROM {table}, (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {table}))
        WHERE n >= {min_count} AND lo_n + hi_n > 0 {'' if zero_iqr else 'AND q1 <> q3'}"""


def outlier_report(table: str, names: list[str]) -> str:
    return f"""
        SELECT "column", low_outliers, high_outliers, total_outliers, outlier_pct, round(lo, 4) AS low_threshold,
               round(hi, 4) AS high_threshold, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, min_outlier, max_outlier,
               CASE WHEN outlier_pct > 10 THEN 'HIGH' WHEN outlier_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
        FROM ({each(names, outliers(table, 10))})"""


@query("g03_iqr_outliers", outlier_report("events", ["value"]))
def _(t):
    return stats.iqr_outliers(t.events, ["value"]).drop("position")


@query("g03_iqr_outliers_dirty", over("dirty_customer", outlier_report("dirty_customer", ["acctbal", "mostly_zero"])))
def _(t):
    return stats.iqr_outliers(t.dirty_customer, ["acctbal", "mostly_zero"]).drop("position")


@query("g04_iqr_outliers_basic", over("dirty_customer", f"""
    SELECT "column", total_outliers AS outliers FROM ({each(["acctbal", "mostly_zero", "c_nationkey"], outliers("dirty_customer", 4, False))})"""))
def _(t):
    return stats.iqr_outliers_basic(t.dirty_customer, ["acctbal", "mostly_zero", "c_nationkey"])


@query("g05_outlier_bounds", f"""
    SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(lo, 4) AS lower_threshold,
           round(hi, 4) AS upper_threshold, total_outliers AS outliers_count, min_outlier, max_outlier
    FROM ({each(["value"], outliers("events", 6))})""")
def _(t):
    return stats.outlier_bounds(t.events, ["value"])


@query("g06_outlier_rows", """
    SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(t):
    return stats.outlier_rows(t.events, "value").select("event_id", "value")


def r_sql(a: str, b: str, table: str) -> str:
    return f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 4) AS r FROM {table}"


@query("g07_correlation_matrix", over("wide_lineitem", " UNION ALL ".join(r_sql(a, b, "wide_lineitem") for a in WIDE for b in WIDE)))
def _(t):
    return stats.correlation_matrix(t.wide_lineitem, WIDE)


@query("g07_correlation_with_gaps", over("dirty_customer", " UNION ALL ".join(
    r_sql(a, b, "dirty_customer") for a in ("c_custkey", "acctbal", "mostly_zero") for b in ("c_custkey", "acctbal", "mostly_zero"))))
def _(t):
    return stats.correlation_matrix(t.dirty_customer, ["c_custkey", "acctbal", "mostly_zero"])


def pairs_sql(table: str, names: list[str]) -> str:
    pairs = " UNION ALL ".join(f"SELECT {i} AS o, * FROM ({r_sql(a, b, table)})" for i, (a, b) in enumerate(combinations(names, 2)))
    return f"""
        SELECT strength, CAST(row_number() OVER (PARTITION BY strength ORDER BY CASE WHEN strength = 'weak' THEN 0 ELSE -abs(r) END, o) AS INTEGER) AS rank, var1, var2, r
        FROM (SELECT *, CASE WHEN r >= 0.5 THEN 'strong positive' WHEN r <= -0.5 THEN 'strong negative' WHEN abs(r) < 0.2 THEN 'weak' END AS strength FROM ({pairs}))
        WHERE strength IS NOT NULL"""


@query("g08_correlation_pairs", over("wide_lineitem", pairs_sql("wide_lineitem", WIDE)))
def _(t):
    return stats.correlation_pairs(t.wide_lineitem, WIDE)


@query("g07_wide", over_wider(" UNION ALL ".join(r_sql(a, b, "wider") for a in WIDE_NUMBERS for b in WIDE_NUMBERS)))
def _(t):
    return stats.correlation_matrix(wider(t), WIDE_NUMBERS)


#: A hundred columns, every fifth with gaps; one DuckDB scan for all pairs.
HUNDRED = [f"m{i:02d}" for i in range(100)]
HUNDRED_SQL = "SELECT " + ", ".join(
    f"CASE WHEN {i} % 5 = 0 AND l_linenumber = {i // 5 % 6 + 1} THEN NULL ELSE (l_partkey * {i + 1} + l_orderkey * {i % 7}) % {97 + 3 * i} END AS {c}"
    for i, c in enumerate(HUNDRED)) + " FROM {lineitem}"
HUNDRED_PAIRS = [(i, j) for i in range(100) for j in range(i, 100)]


@query("g07_hundred", f"""
    WITH m AS ({HUNDRED_SQL.replace('{lineitem}', 'lineitem')}),
    c AS (SELECT {", ".join(f"round(corr({HUNDRED[i]}, {HUNDRED[j]}), 4) AS p{i:02d}{j:02d}" for i, j in HUNDRED_PAIRS)} FROM m),
    u AS (SELECT 'm' || substr(pair, 2, 2) AS a, 'm' || substr(pair, 4, 2) AS b, r FROM (UNPIVOT c ON * INTO NAME pair VALUE r))
    SELECT a AS var1, b AS var2, r FROM u UNION ALL SELECT b, a, r FROM u WHERE a <> b""")
def _(t):
    return stats.correlation_matrix(t.spark.sql(HUNDRED_SQL, lineitem=t.lineitem), HUNDRED)


@query("g08_wide", over_wider(pairs_sql("wider", WIDE_NUMBERS)))
def _(t):
    return stats.correlation_pairs(wider(t), WIDE_NUMBERS)


@query("g09_strong_correlations", over("wide_lineitem", f"""
    SELECT var1, var2, r, CASE WHEN r > 0 THEN 'strong positive' ELSE 'strong negative' END AS strength
    FROM ({" UNION ALL ".join(r_sql(a, b, "wide_lineitem") for a, b in combinations(["l_quantity", "l_extendedprice", "net_price", "neg_price", "l_tax"], 2))})
    WHERE abs(r) >= 0.70"""))
def _(t):
    return stats.strong_correlations(t.wide_lineitem, ["l_quantity", "l_extendedprice", "net_price", "neg_price", "l_tax"])


@query("g10_primary_metric", """
    SELECT 'o_totalprice' AS metric UNION ALL SELECT * FROM (SELECT "column" FROM (
        SELECT 's_suppkey' AS "column", var_samp(s_suppkey) AS v FROM supplier UNION ALL SELECT 's_nationkey', var_samp(s_nationkey) FROM supplier
        UNION ALL SELECT 's_acctbal', var_samp(s_acctbal) FROM supplier) ORDER BY v DESC LIMIT 1)""")
def _(t):
    named = stats.primary_metric_row(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"])
    return named.unionByName(stats.primary_metric_row(t.supplier, ["s_suppkey", "s_nationkey", "s_acctbal"]))


def zscores(table: str, names: list[str]) -> str:
    return f"""
        SELECT "column", 'extreme_value' AS type, CASE WHEN pct > 5 THEN 'HIGH' WHEN pct > 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CAST(far AS DOUBLE) AS value, pct
        FROM (SELECT "column", far, round(100.0 * far / n, 2) AS pct FROM ({each(names, f'''
            SELECT '{{c}}' AS "column", count({{c}}) AS n, count(*) FILTER (WHERE abs({{c}} - m) / nullif(s, 0) > 3) AS far
            FROM {table}, (SELECT avg({{c}}) AS m, stddev_samp({{c}}) AS s FROM {table})''')}) WHERE n >= 15) WHERE pct > 0"""


@query("g11_zscore_anomalies", zscores("events", ["event_id", "user_id", "value"]))
def _(t):
    return stats.zscore_anomalies(t.events, ["event_id", "user_id", "value"])


@query("g11_wide", over_wider(zscores("wider", WIDE_NUMBERS)))
def _(t):
    return stats.zscore_anomalies(wider(t), WIDE_NUMBERS)


def spikes(table: str, date: str, names: list[str]) -> str:
    return f"""
        SELECT "column", month, CASE WHEN gap > 0 THEN 'spike_detected' ELSE 'drop_detected' END AS type,
               CASE WHEN abs(gap) > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(m, 4) AS value, round(100 * gap, 2) AS pct
        FROM ({each(names, f'''
            SELECT '{{c}}' AS "column", month, m, (m - avg(m) OVER ()) / abs(avg(m) OVER ()) AS gap, count(*) OVER () AS months, sum(n) OVER () AS rows
            FROM (SELECT strftime({date}, '%Y-%m') AS month, avg({{c}}) AS m, count({{c}}) AS n FROM {table} WHERE {{c}} IS NOT NULL GROUP BY 1)''')})
        WHERE rows >= 20 AND months >= 4 AND abs(gap) > 0.5"""


@query("g12_period_spikes", over("busy_orders", spikes("busy_orders", "ordered_on", ["price"])))
def _(t):
    return stats.period_spikes(t.busy_orders, "ordered_on", ["price"])


def zeros(table: str, names: list[str]) -> str:
    return each(names, f"""
        SELECT '{{c}}' AS "column", 'excessive_zeros' AS type, 'MEDIUM' AS severity, CAST(count(*) FILTER (WHERE {{c}} = 0) AS DOUBLE) AS value,
               round(100.0 * count(*) FILTER (WHERE {{c}} = 0) / count(*), 2) AS pct FROM {table} HAVING count(*) FILTER (WHERE {{c}} = 0) > 0.5 * count(*)""")


def negatives(table: str, names: list[str]) -> str:
    return each(names, f"""
        SELECT '{{c}}' AS "column", 'negative_values' AS type, 'LOW' AS severity, CAST(count(*) FILTER (WHERE {{c}} < 0) AS DOUBLE) AS value,
               round(100.0 * count(*) FILTER (WHERE {{c}} < 0) / count(*), 2) AS pct FROM {table}
        HAVING round(100.0 * count(*) FILTER (WHERE {{c}} < 0) / count(*), 2) > 1""")


@query("g13_excess_zeros", over("dirty_customer", zeros("dirty_customer", ["c_custkey", "acctbal", "mostly_zero"])))
def _(t):
    return stats.excess_zeros(t.dirty_customer, ["c_custkey", "acctbal", "mostly_zero"])


@query("g14_negative_share", negatives("customer", ["c_custkey", "c_acctbal"]))
def _(t):
    return stats.negative_share(t.customer, ["c_custkey", "c_acctbal"])


def anomalies_sql(table: str, date: str, names: list[str]) -> str:
    return f"""
        SELECT * FROM ({zscores(table, names)}) UNION ALL SELECT * FROM ({zeros(table, names)}) UNION ALL SELECT * FROM ({negatives(table, names)})
        UNION ALL SELECT "column", type, severity, value, pct FROM ({spikes(table, date, names)})
        UNION ALL SELECT "column", 'high_severity_outliers', severity, CAST(total_outliers AS DOUBLE), outlier_pct
                  FROM ({outlier_report(table, names)}) WHERE severity = 'HIGH'"""


@query("g15_anomalies", over("busy_orders", anomalies_sql("busy_orders", "ordered_on", ["price", "refund", "order_no"])))
def _(t):
    return stats.anomalies(t.busy_orders, ["price", "refund", "order_no"], ["ordered_on"])


@query("g16_skewed_metric", """
    SELECT 'value' AS metric, round(m, 4) AS mean, round(md, 4) AS median
    FROM (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS md FROM events) WHERE abs(m - md) / abs(m) > 0.3""")
def _(t):
    return stats.skewed_metric(t.events, "value")
