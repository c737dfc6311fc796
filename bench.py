"""Times the headline operators and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the number of cores.
Every query runs once unmeasured to start the JVM paths, then once measured to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabulight.operators import findings, quality, rows, schema, segments, stats, timeseries  # noqa: E402
from tabulight.plans.profile import union_all  # noqa: E402
from tabulight.session import local_session  # noqa: E402

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def whole(frames: dict) -> object:
    return union_all([f.agg(F.count("*").alias("rows")).select(F.lit(n).alias("part"), "rows") for n, f in frames.items()])


def workload(spark, sf_dir):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    line, orders, events = t("lineitem"), t("orders"), t("events")
    types = schema.semantic_types(orders)
    return {
        "quartiles_exact": lambda: stats.outlier_bounds(line, NUMBERS),
        "quartiles_approx": lambda: stats.outlier_bounds(line, NUMBERS, stats.quartiles(line, NUMBERS, approx=True)),
        "stat_summary": lambda: stats.stat_summary(line, NUMBERS),
        "correlation": lambda: stats.correlation_matrix(line, NUMBERS),
        "distinct_exact": lambda: quality.distinct_counts(line),
        "distinct_approx": lambda: quality.distinct_counts(line, approx=True),
        "duplicates": lambda: quality.duplicate_count(line),
        "missing_profile": lambda: quality.missing_profile(line),
        "detect_schema": lambda: schema.detect_schema(t("documents")),
        "column_quality": lambda: quality.column_quality(orders, types),
        "category_analysis": lambda: segments.category_analysis(line, ["l_returnflag", "l_linestatus"], "l_extendedprice"),
        "share_by_category": lambda: segments.share_by_category(t("part"), "p_brand", "p_retailprice"),
        "drill_page": lambda: rows.drill_table(orders, types, {"o_orderstatus": ["F"]}, "urgent", "o_totalprice", "DESC", 3,
                                               20, ["o_orderkey"])[0],
        "trend_report": lambda: timeseries.trend_report(line, ["l_shipdate"], NUMBERS[4:7]),
        "trend_by_date": lambda: timeseries.trend_by_date(events, "ts", "value"),
        "anomalies": lambda: stats.anomalies(line, NUMBERS, ["l_shipdate"]),
        "full_report": lambda: whole(findings.full_report(line)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times = {}
    for name, build in workload(spark, sf_dir).items():
        build().collect()
        start = time.perf_counter()
        build().collect()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline operators, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
