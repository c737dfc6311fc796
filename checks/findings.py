from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks import segments as seg, stats as st, timeseries as ts
from checks.fixtures import over
from checks.registry import each, query
from tabulight.operators import findings
from tabulight.plans.profile import union_all

NUMERIC, DATES, TEXTS = ["price", "refund", "order_no"], ["ordered_on"], ["status", "priority", "clerk"]
CLASSES = {"numeric": NUMERIC, "date": DATES, "categorical": TEXTS}
ALL = ["order_no", "ordered_on", "price", "refund", "status", "priority", "clerk"]
TABLE = "busy_orders"

CONCENTRATED = " UNION ALL ".join(
    f"SELECT * FROM ({seg.concentration(TABLE, c, i)}) WHERE concentration = 'High'" for i, c in enumerate(TEXTS))
H1 = f"""SELECT 'concentration_risk' AS type, "column" AS subject, 'HIGH' AS priority, top_3_pct AS v1, top_pct AS v2 FROM ({CONCENTRATED})"""

TRENDS = ts.report(*[ts.months(TABLE, "ordered_on", c) for c in NUMERIC])
H2 = f"""
    SELECT CASE WHEN direction = 'upward' THEN 'growth_opportunity' ELSE 'declining_trend' END AS type, metric AS subject,
           CASE WHEN strength = 'strong' THEN 'HIGH' ELSE 'MEDIUM' END AS priority, slope AS v1, CAST(NULL AS DOUBLE) AS v2 FROM ({TRENDS})
    UNION ALL SELECT 'recent_change', metric, 'MEDIUM', last_change_pct, NULL FROM ({TRENDS}) WHERE abs(last_change_pct) > 20"""


def gap_rows(table: str, names: list[str], metric: str) -> str:
    return each(names, f"""
        SELECT 'performance_gap' AS type, '{{c}}' AS subject, CASE WHEN 100 * (max(m) - min(m)) / min(m) > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
               round(max(m) - min(m), 4) AS v1, round(100 * (max(m) - min(m)) / min(m), 2) AS v2
        FROM (SELECT {{c}} AS v, avg({metric}) AS m FROM {table} WHERE {{c}} IS NOT NULL GROUP BY 1)
        HAVING count(*) >= 2 AND max(m) > min(m) AND 100 * (max(m) - min(m)) / min(m) > 10""")


PAIRS = st.pairs_sql(TABLE, NUMERIC)
H4 = f"""
    SELECT 'correlation_opportunity' AS type, var1 || ' / ' || var2 AS subject, CASE WHEN r > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
           r AS v1, CAST(NULL AS DOUBLE) AS v2 FROM ({PAIRS}) WHERE strength = 'strong positive' AND rank <= 2
    UNION ALL SELECT 'tradeoff_insight', var1 || ' / ' || var2, 'MEDIUM', r, NULL FROM ({PAIRS}) WHERE strength = 'strong negative' AND rank = 1"""

OUTLIERS = st.outlier_report(TABLE, NUMERIC)
ANOMALIES = st.anomalies_sql(TABLE, "ordered_on", NUMERIC)
H5 = f"""
    SELECT 'data_quality_risk' AS type, 'outliers' AS subject, 'HIGH' AS priority, CAST(count(*) AS DOUBLE) AS v1, CAST(NULL AS DOUBLE) AS v2
      FROM ({OUTLIERS}) WHERE severity = 'HIGH' HAVING count(*) > 0
    UNION ALL SELECT 'anomaly_alert', 'anomalies', 'HIGH', count(*), NULL FROM ({ANOMALIES}) WHERE severity = 'HIGH' HAVING count(*) > 0
    UNION ALL SELECT 'missing_data_warning', 'price', 'MEDIUM', count(*) - count(price), round(100.0 * (count(*) - count(price)) / count(*), 2)
      FROM {TABLE} HAVING count(*) > count(price)
    UNION ALL SELECT 'skewed_distribution', 'price', 'MEDIUM', round(m, 4), round(md, 4)
      FROM (SELECT avg(price) AS m, quantile_cont(price, 0.5) AS md FROM {TABLE}) WHERE abs(m - md) / abs(m) > 0.3
    UNION ALL SELECT * FROM (SELECT 'segmentation_opportunity', "column", 'MEDIUM', d, NULL FROM
      ({each(TEXTS, f'SELECT {{i}} AS i, chr(0) AS x, {chr(39)}{{c}}{chr(39)} AS "column", count(DISTINCT {{c}}) AS d FROM {TABLE}')})
      WHERE d BETWEEN 10 AND 100 ORDER BY d DESC, i LIMIT 1)"""

H3 = gap_rows(TABLE, TEXTS, "price")
H6 = " UNION ALL ".join(f"SELECT * FROM ({h})" for h in (H1, H2, H3, H4, H5))


def busy(sql: str) -> str:
    return over(TABLE, sql)


@query("h01_insight_concentration", busy(H1))
def _(t):
    return findings.insight_concentration(t.busy_orders, TEXTS)


@query("h02_insight_trends", busy(H2))
def _(t):
    return findings.insight_trends(t.busy_orders, DATES, NUMERIC)


@query("h03_insight_performance_gap", gap_rows("part", ["p_brand", "p_name"], "p_retailprice"))
def _(t):
    return findings.insight_performance_gap(t.part, ["p_brand", "p_name"], ["p_retailprice"])


@query("h03_insight_performance_gap_large", over("dirty_customer", gap_rows("dirty_customer", ["segment", "active_flag"], "c_custkey")))
def _(t):
    return findings.insight_performance_gap(t.dirty_customer, ["segment", "active_flag"], ["c_custkey"])


@query("h04_insight_correlation", busy(H4))
def _(t):
    return findings.insight_correlation(t.busy_orders, NUMERIC)


@query("h05_insight_risk", busy(H5))
def _(t):
    return findings.insight_risk(t.busy_orders, CLASSES)


@query("h06_business_insights", busy(H6))
def _(t):
    return findings.business_insights(t.busy_orders, CLASSES)


CELLS = " + ".join(f"(count(*) - count({c}))" for c in ALL)
H7 = f"""
    SELECT 'Data Quality' AS area, 'missing values' AS subject, CASE WHEN round(100.0 * n / cells, 2) > 5 THEN 'HIGH' ELSE 'LOW' END AS priority
      FROM (SELECT {CELLS} AS n, {len(ALL)} * count(*) AS cells FROM {TABLE}) WHERE n > 0
    UNION ALL SELECT 'Data Quality', 'duplicate rows', CASE WHEN round(100.0 * d / n, 2) > 10 THEN 'HIGH' ELSE 'MEDIUM' END
      FROM (SELECT sum(k) AS n, sum(k - 1) AS d FROM (SELECT count(*) AS k FROM {TABLE} GROUP BY {', '.join(ALL)})) WHERE d > 0
    UNION ALL SELECT CASE WHEN direction = 'downward' THEN 'Performance' ELSE 'Growth' END, metric,
                     CASE WHEN direction = 'downward' THEN 'HIGH' ELSE 'MEDIUM' END FROM ({TRENDS}) WHERE strength IN ('strong', 'moderate')
    UNION ALL SELECT 'Risk Management', "column", 'HIGH' FROM ({CONCENTRATED})
    UNION ALL SELECT 'Data Quality', 'outliers', 'MEDIUM' FROM ({OUTLIERS}) WHERE severity = 'HIGH' HAVING count(*) > 0
    UNION ALL SELECT 'Performance Improvement', subject, 'HIGH' FROM ({H3}) WHERE priority = 'HIGH'
    UNION ALL SELECT 'Visualization', 'price', 'MEDIUM'
    UNION ALL SELECT 'Advanced Analytics', 'price', 'LOW' FROM {TABLE} HAVING count(*) >= 100"""


@query("h07_recommendations", busy(H7))
def _(t):
    return findings.recommendations(t.busy_orders, CLASSES)


@query("h08_executive_summary", busy(f"""
    SELECT CAST(seq AS INTEGER) AS seq, topic, subject, CAST(value AS DOUBLE) AS value FROM (
      SELECT 1 AS seq, 'theme' AS topic, 'Sales / E-commerce' AS subject, NULL AS value UNION ALL
      SELECT 2, 'rows', NULL, count(*) FROM {TABLE} UNION ALL
      SELECT 3, 'columns', NULL, 7 UNION ALL SELECT 4, 'numeric columns', NULL, 3 UNION ALL
      SELECT 5, 'categorical columns', NULL, 3 UNION ALL SELECT 6, 'date columns', NULL, 1 UNION ALL
      SELECT 7, 'metric mean', 'price', round(avg(price), 4) FROM {TABLE} UNION ALL
      SELECT 8, 'metric median', 'price', round(quantile_cont(price, 0.5), 4) FROM {TABLE} UNION ALL
      SELECT 9, 'missing cells', NULL, {CELLS} FROM {TABLE} UNION ALL
      SELECT 10, 'duplicate rows', NULL, sum(k - 1) FROM (SELECT count(*) AS k FROM {TABLE} GROUP BY {', '.join(ALL)}) UNION ALL
      SELECT 11, 'upward trends', NULL, count(*) FROM ({TRENDS}) WHERE direction = 'upward' UNION ALL
      SELECT 12, 'downward trends', NULL, count(*) FROM ({TRENDS}) WHERE direction = 'downward' UNION ALL
      SELECT 13, 'outlier columns', NULL, count(*) FROM ({OUTLIERS}) UNION ALL
      SELECT 14, 'high severity risks', NULL, (SELECT count(*) FROM ({OUTLIERS}) WHERE severity = 'HIGH') + (SELECT count(*) FROM ({ANOMALIES}) WHERE severity = 'HIGH') UNION ALL
      SELECT 15, 'concentrated columns', NULL, count(*) FROM ({CONCENTRATED}) UNION ALL
      SELECT 16, 'high priority findings', NULL, count(*) FROM ({H6}) WHERE priority = 'HIGH')"""))
def _(t):
    return findings.executive_summary(t.busy_orders, CLASSES)


TYPES = {"order_no": "NUM", "ordered_on": "DATE", "price": "NUM", "refund": "NUM", "status": "TEXT", "priority": "TEXT", "clerk": "TEXT"}


@query("h09_dashboard_findings", over("dirty_customer", """
, f AS (SELECT * FROM dirty_customer WHERE active_flag = 'no'), n AS (SELECT count(*) AS n FROM f)
    SELECT CAST(row_number() OVER (ORDER BY r, p) AS INTEGER) AS seq, rule, subject, value, detail FROM (
      SELECT 1 AS r, 2 AS p, 'missing' AS rule, 'segment' AS subject, round(100.0 * (n - (SELECT count(segment) FROM f)) / n, 1) AS value, NULL AS detail FROM n
        WHERE 100.0 * (n - (SELECT count(segment) FROM f)) / n > 5
      UNION ALL SELECT 1, 3, 'missing', 'acctbal', round(100.0 * (n - (SELECT count(acctbal) FROM f)) / n, 1), NULL FROM n
        WHERE 100.0 * (n - (SELECT count(acctbal) FROM f)) / n > 5
      UNION ALL SELECT 1, 8, 'missing', 'empty_col', 100.0, NULL FROM n
      UNION ALL SELECT 2, 0, 'duplicates', 'rows', round(100.0 * d / (SELECT n FROM n), 1), NULL
        FROM (SELECT (SELECT n FROM n) - count(*) AS d FROM (SELECT DISTINCT * FROM f)) WHERE 100.0 * d / (SELECT n FROM n) > 1
      UNION ALL SELECT 3, 1, 'outliers', 'mostly_zero', CAST(count(*) AS DOUBLE), NULL FROM f,
          (SELECT quantile_cont(mostly_zero, 0.25) AS q1, quantile_cont(mostly_zero, 0.75) AS q3 FROM f)
        WHERE mostly_zero < q1 - 1.5 * (q3 - q1) OR mostly_zero > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0
      UNION ALL SELECT 4, 3, 'concentration', 'const_col', 100.0, 'same' FROM f HAVING sum(acctbal) > 0
      UNION ALL SELECT 5, 1, 'correlation', 'acctbal / mostly_zero', round(corr(acctbal, mostly_zero), 2), NULL FROM f HAVING abs(corr(acctbal, mostly_zero)) >= 0.7)
    ORDER BY r, p"""))
def _(t):
    types = {"c_custkey": "TEXT", "segment": "TEXT", "acctbal": "NUM", "mixed_code": "TEXT", "active_flag": "BOOL", "mostly_zero": "NUM",
             "const_col": "TEXT", "empty_col": "TEXT", "c_nationkey": "BOOL"}
    return findings.dashboard_findings(t.dirty_customer, types, {"active_flag": "no"})


NUMS = ["price", "refund", "order_no"]


@query("h09_dashboard_findings_busy", busy(f"""
    SELECT CAST(row_number() OVER (ORDER BY r, p) AS INTEGER) AS seq, rule, subject, value, detail FROM (
      SELECT 3 AS r, {{i}} AS p, 'outliers' AS rule, "column" AS subject, CAST(total_outliers AS DOUBLE) AS value, NULL AS detail
        FROM ({OUTLIERS})
      UNION ALL SELECT 4, 0, 'concentration', "column", round(share_pct, 1), category FROM ({seg.dominant(TABLE, 'status', 'price')}) WHERE dominant
      UNION ALL SELECT 4, 1, 'concentration', "column", round(share_pct, 1), category FROM ({seg.dominant(TABLE, 'priority', 'price')}) WHERE dominant
      UNION ALL SELECT 4, 2, 'concentration', "column", round(share_pct, 1), category FROM ({seg.dominant(TABLE, 'clerk', 'price')}) WHERE dominant
      UNION ALL SELECT 5, row_number() OVER (), 'correlation', var1 || ' / ' || var2, round(r, 2), CASE WHEN r > 0 THEN 'strong positive' ELSE 'strong negative' END
        FROM ({" UNION ALL ".join(st.r_sql(a, b, TABLE) for a, b in combinations(NUMS, 2))}) WHERE abs(r) >= 0.7
      UNION ALL SELECT 6, 0, 'trend', metric, change_pct, direction FROM ({ts.by_date(TABLE, 'ordered_on', 'price')}))
    ORDER BY r, p""".replace("{i}", "CASE \"column\" WHEN 'price' THEN 1 WHEN 'refund' THEN 2 ELSE 3 END")))
def _(t):
    df = t.busy_orders.select("price", "refund", "order_no", "ordered_on", "status", "priority", "clerk")
    return findings.dashboard_findings(df, TYPES)


@query("h10_full_report", busy(f"""
    SELECT 'overview' AS section, CAST(7 AS BIGINT) AS rows UNION ALL
    SELECT 'quality', {" + ".join(f"CAST(count(*) > count({c}) AS INTEGER)" for c in ALL)} FROM {TABLE} UNION ALL
    SELECT 'size', 1 UNION ALL SELECT 'duplicates', 1 UNION ALL SELECT 'trend_counts', 1 UNION ALL
    SELECT 'constant', {" + ".join(f"CAST(count(DISTINCT {c}) <= 1 AS INTEGER)" for c in ALL)} FROM {TABLE} UNION ALL
    SELECT 'top_records', least(10, count(price)) FROM {TABLE} UNION ALL SELECT 'bottom_records', least(10, count(price)) FROM {TABLE} UNION ALL
    SELECT 'notable', count(*) FILTER (WHERE variability = 'High') + count(*) FILTER (WHERE skewness <> 'Normal') FROM ({each(NUMERIC, st.SUMMARY.replace("lineitem", TABLE))}) UNION ALL
    SELECT 'statistics', 3 UNION ALL SELECT 'outliers', count(*) FROM ({OUTLIERS}) UNION ALL
    SELECT 'correlation', count(*) FROM ({PAIRS}) UNION ALL SELECT 'trends', count(*) FROM ({TRENDS}) UNION ALL
    SELECT 'categories', 3 UNION ALL SELECT 'performance', 1 UNION ALL
    SELECT 'segment_gaps', count(*) FROM ({" UNION ALL ".join(seg.gap(TABLE, c, 0, 'price') for c in TEXTS)}) UNION ALL
    SELECT 'anomalies', count(*) FROM ({ANOMALIES}) UNION ALL SELECT 'insights', count(*) FROM ({H6}) UNION ALL
    SELECT 'recommendations', count(*) FROM ({H7}) UNION ALL SELECT 'summary', 16"""))
def _(t):
    parts = findings.full_report(t.busy_orders, CLASSES)
    return union_all([p.agg(F.count("*").alias("rows")).select(F.lit(n).alias("section"), "rows") for n, p in parts.items()])
