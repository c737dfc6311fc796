from __future__ import annotations

from pyspark.sql import functions as F

from checks import stats as st
from checks.fixtures import over
from checks.registry import query
from tabulight.operators import timeseries


def months(table: str, date: str, metric: str, parse: str | None = None) -> str:
    return f"""SELECT '{date}' AS date_column, '{metric}' AS metric, strftime({parse or date}, '%Y-%m') AS month, avg({metric}) AS mean,
                      sum({metric}) AS sum, count({metric}) AS count FROM {table} WHERE {metric} IS NOT NULL AND {parse or date} IS NOT NULL GROUP BY 3"""


def trends(m: str) -> str:
    return f"""
        SELECT date_column, metric, CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END AS direction,
               CASE WHEN abs(slope) > 1 THEN 'strong' WHEN abs(slope) > 0.1 THEN 'moderate' ELSE 'slight' END AS strength,
               round(slope, 6) AS slope, periods,
               CASE WHEN periods < 6 THEN NULL WHEN late > early * 1.1 THEN 'accelerating' WHEN early > late * 1.1 THEN 'decelerating' END AS half_shift
        FROM (SELECT date_column, metric, any_value(p) AS periods, regr_slope(mean, i) AS slope, sum(count) AS rows,
                     avg(mean) FILTER (WHERE i < p // 2) AS early, avg(mean) FILTER (WHERE i >= p // 2) AS late
              FROM (SELECT *, row_number() OVER (PARTITION BY date_column, metric ORDER BY month) - 1 AS i,
                           count(*) OVER (PARTITION BY date_column, metric) AS p FROM ({m})) GROUP BY 1, 2)
        WHERE rows >= 15 AND periods >= 3"""


def changes(m: str) -> str:
    return f"""
        SELECT *, CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' ELSE 'flat' END AS direction
        FROM (SELECT date_column, metric, month AS period,
                     CASE WHEN before = 0 THEN 0.0 ELSE round(100 * (mean - before) / abs(before), 2) END AS change_pct,
                     row_number() OVER (PARTITION BY date_column, metric ORDER BY month DESC) AS from_end
              FROM (SELECT *, lag(mean) OVER (PARTITION BY date_column, metric ORDER BY month) AS before FROM ({m}))
              WHERE before IS NOT NULL)"""


BUSY = months("busy_orders", "ordered_on", "price")


@query("t01_monthly", over("busy_orders", f"SELECT month, round(mean, 4) AS mean, round(sum, 2) AS sum, count FROM ({BUSY})"))
def _(t):
    return timeseries.monthly(t.busy_orders, "ordered_on", "price").select(
        "month", F.round("mean", 4).alias("mean"), F.round("sum", 2).alias("sum"), "count")


@query("t01_monthly_text_dates", over("dirty_orders", """
    SELECT strftime(try_strptime(order_day, '%Y-%m-%d'), '%Y-%m') AS month, round(avg(CAST(price_text AS DOUBLE)), 4) AS mean, count(*) AS count
    FROM dirty_orders WHERE try_strptime(order_day, '%Y-%m-%d') IS NOT NULL GROUP BY 1"""))
def _(t):
    return timeseries.monthly(t.dirty_orders, "order_day", "price_text").select("month", F.round("mean", 4).alias("mean"), "count")


def order_months(text: str) -> str:
    return f"""
        SELECT strftime(d, '%Y-%m') AS month, round(avg(p), 4) AS mean, count(*) AS count
        FROM (SELECT {text} AS d, o_totalprice AS p FROM orders) GROUP BY 1"""


@query("t01_monthly_us_dates", order_months("strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')"))
def _(t):
    text = t.orders.selectExpr("date_format(o_orderdate, 'MM/dd/yyyy') as day", "o_totalprice")
    return timeseries.monthly(text, "day", "o_totalprice").select("month", F.round("mean", 4).alias("mean"), "count")


@query("t01_monthly_iso_t", order_months("o_orderdate"))
def _(t):
    text = t.orders.selectExpr("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as day", "o_totalprice")
    return timeseries.monthly(text, "day", "o_totalprice").select("month", F.round("mean", 4).alias("mean"), "count")


@query("t02_trend", over("busy_orders", f"SELECT * EXCLUDE (half_shift) FROM ({trends(BUSY)})"))
def _(t):
    return timeseries.trend(t.busy_orders, "ordered_on", "price")


@query("t03_mom_changes", over("busy_orders", f"SELECT * EXCLUDE (from_end) FROM ({changes(BUSY)}) WHERE from_end <= 6"))
def _(t):
    return timeseries.mom_changes(t.busy_orders, "ordered_on", "price")


@query("t03_mom_changes_all", over("busy_orders", f"SELECT * EXCLUDE (from_end) FROM ({changes(BUSY)})"))
def _(t):
    return timeseries.mom_changes(t.busy_orders, "ordered_on", "price", None)


# order numbers above the median only start late: their count per month cannot, so scale the price by year
GROWING = "SELECT ordered_on, price * (year(ordered_on) - 1990) AS grown FROM busy_orders"


@query("t04_half_shift", over("busy_orders", f""", growing AS ({GROWING})
    SELECT date_column, metric, half_shift FROM ({trends(months('growing', 'ordered_on', 'grown'))}) WHERE half_shift IS NOT NULL"""))
def _(t):
    growing = t.busy_orders.select("ordered_on", (F.col("price") * (F.year("ordered_on") - 1990)).alias("grown"))
    return timeseries.half_shift(growing, "ordered_on", "grown")


def by_date(table: str, date: str, metric: str) -> str:
    return f"""
        SELECT '{date}' AS date_column, '{metric}' AS metric, count(*) AS dates,
               CASE WHEN regr_slope(total, i) > 0 THEN 'upward' ELSE 'downward' END AS direction,
               round(100 * (arg_max(total, day) - arg_min(total, day)) / arg_min(total, day), 1) AS change_pct,
               strftime(min(day), '%Y-%m-%d') AS first_date, strftime(max(day), '%Y-%m-%d') AS last_date
        FROM (SELECT day, total, row_number() OVER (ORDER BY day) - 1 AS i FROM (
                SELECT {date} AS day, sum({metric}) AS total FROM {table} WHERE {date} IS NOT NULL GROUP BY 1) WHERE total IS NOT NULL)
        HAVING count(*) >= 4 AND arg_min(total, day) > 0"""


@query("t05_trend_by_date", by_date("orders", "o_orderdate", "o_totalprice"))
def _(t):
    return timeseries.trend_by_date(t.orders, "o_orderdate", "o_totalprice")


@query("t05_trend_by_date_events", by_date("events", "ts", "value"))
def _(t):
    return timeseries.trend_by_date(t.events, "ts", "value")


def report(*parts: str) -> str:
    m = " UNION ALL ".join(parts)
    return f"""
        SELECT t.*, c.period AS last_period, c.change_pct AS last_change_pct FROM ({trends(m)}) t
        LEFT JOIN ({changes(m)}) c ON t.date_column = c.date_column AND t.metric = c.metric AND c.from_end = 1"""


BUSY_REPORT = report(*[months("busy_orders", "ordered_on", c) for c in ("order_no", "price", "refund")])


@query("t06_trend_report", over("busy_orders", BUSY_REPORT))
def _(t):
    return timeseries.trend_report(t.busy_orders, ["ordered_on"], ["order_no", "price", "refund"])


@query("t06_wide", st.over_wider(report(*[months("wider", d, c) for d in st.WIDE_DATES for c in st.WIDE_NUMBERS])))
def _(t):
    return timeseries.trend_report(st.wider(t), st.WIDE_DATES, st.WIDE_NUMBERS)


@query("t06_trend_counts", over("busy_orders", f"""
    SELECT count(*) FILTER (WHERE direction = 'upward') AS growth, count(*) FILTER (WHERE direction = 'downward') AS decline FROM ({BUSY_REPORT})"""))
def _(t):
    return timeseries.trend_counts(timeseries.trend_report(t.busy_orders, ["ordered_on"], ["order_no", "price", "refund"]))


# the last month is multiplied so that the rule fires
LAST = "SELECT ordered_on, price * CASE WHEN ordered_on >= (SELECT date_trunc('month', max(ordered_on)) FROM busy_orders) THEN 2 ELSE 1 END AS price FROM busy_orders"


@query("t07_recent_change", over("busy_orders", f""", jump AS ({LAST})
    SELECT * EXCLUDE (from_end) FROM ({changes(months('jump', 'ordered_on', 'price'))}) WHERE from_end = 1 AND abs(change_pct) > 20"""))
def _(t):
    return timeseries.recent_change(t.spark.sql(LAST.replace("busy_orders", "{busy}"), busy=t.busy_orders), "ordered_on", "price")
