"""What the plans must look like to hold on a large cluster."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabulight.operators import quality, segments, stats

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_one_scan_and_one_row_of_exchange(spark):
    text = plan(quality.missing_profile(spark.read.parquet(f"{SF_DIR}/lineitem.parquet")))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Exchange SinglePartition" in text


def test_filters_reach_the_scan(spark):
    text = QUERIES["b04_apply_filters"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"DataFilters: \[(.*?)\]", text).group(1)
    assert "o_totalprice" in pushed and "o_orderdate" in pushed and "o_orderstatus" in pushed


def test_unused_columns_are_not_read(spark):
    text = plan(segments.dominant_category(spark.read.parquet(f"{SF_DIR}/orders.parquet"), "o_orderpriority", "o_totalprice"))
    assert re.search(r"FileScan parquet \[o_totalprice#\d+,o_orderpriority#\d+\]", text)


def test_top_rows_are_not_globally_sorted(spark):
    for name in ("c02_top_n", "c05_page", "c01_head"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF_DIR))


def test_deep_page_is_a_range_of_few_rows(spark, monkeypatch):
    """The rows before a deep page are counted, not gathered: what is sorted lies between two cuts."""
    from tabulight.operators import rows
    monkeypatch.setattr(rows, "PAGED_ROWS", 500)
    line = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    terms = rows._terms(line, "l_extendedprice", "ASC", ["l_orderkey", "l_linenumber"])
    around, skipped = rows._range_of(line, terms, 3000, 20)
    assert around.count() <= 540 and 0 <= skipped <= 520
    assert "TakeOrderedAndProject" in plan(rows.page(line, 151, 20, "l_extendedprice", "ASC", ["l_orderkey", "l_linenumber"]))


def test_correlation_of_many_columns_is_one_scan(spark):
    line = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr("*", *[f"l_partkey % {i + 3} as n{i}" for i in range(40)])
    text = plan(stats.correlation_matrix(line, [f"n{i}" for i in range(40)]))
    assert text.count("FileScan") == 1 and "MapInArrow" in text


def test_wide_correlation_reads_the_table_once(spark):
    """No scan for means comes first; tasks far apart, gaps, constant and infinite columns are merged right (F4)."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 30)) + np.arange(30) * 1e6 + (np.arange(400) // 100 * 50.0)[:, None]
    x[:, 4], x[rng.random(400) < 0.3, 5], x[7, 6], x[:, 8] = 7.0, np.nan, np.inf, np.nan
    names = [f"v{i}" for i in range(30)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)).repartition(4)
    spark.sparkContext.setJobGroup("wide correlation", "")
    matrix = stats.correlation_matrix(df, names)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("wide correlation")
    got = {(r.var1, r.var2): r.r for r in matrix.collect()}
    assert len(got) == 900
    for i in range(30):
        for j in range(30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if {i, j} & {4, 6, 8} else np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert got[names[i], names[j]] == (want if want is None else pytest.approx(want, abs=1e-4))
    assert {r.r for r in stats.correlation_matrix(df.where("v0 > 1e9"), names).collect()} == {None}


def test_rows_between_cuts_are_found_by_halving(spark):
    """A row is compared with one cut a level, not with all of them (F2)."""
    from tabulight.operators import rows
    df = spark.createDataFrame([(i % 7 if i % 5 else None, float("nan") if i % 11 == 0 else i / 3) for i in range(300)], "a int, b double")
    terms = rows._terms(df, "a", "DESC", ["b"])
    drawn = df.orderBy(*rows._order(terms)).collect()[3::9]
    cuts = [[F.lit(v).cast(k) for v, k in zip(r, ("int", "double"))] for r in drawn]
    place = rows._place([rows._before(terms, r, c) for r, c in zip(drawn, cuts)])
    found = {r["p"]: r["count"] for r in df.groupBy(place.alias("p")).count().collect()}
    before = [df.where(rows._before(terms, r, c)).count() for r, c in zip(drawn, cuts)]
    assert [sum(found.get(i, 0) for i in range(k + 1)) for k in range(len(cuts))] == before and sum(found.values()) == 300


def test_many_places_are_counted_outside_generated_code(spark):
    """Ranks of wide tables are counted by Arrow batches: infinite and missing values, both zeros (F3)."""
    from tabulight.plans import quantiles
    inf = float("inf")
    df = spark.createDataFrame([(x, y) for x in (-inf, -1.0, -0.0, 0.0, 2.0, inf, None) for y in (None, 5.0)], "v0 double, v1 double").repartition(3)
    got = quantiles._counts(df, {"v0": [-inf, -0.0, 1.0, inf], "v1": [5.0]})
    assert got == {("v0", -inf): (0, 2), ("v0", -0.0): (4, 8), ("v0", 1.0): (8, 8), ("v0", inf): (10, 12), ("v1", 5.0): (0, 7)}
    inside = quantiles._inside(df, [("v0", -1.0, None), ("v1", None, 5.0), ("v0", -inf, inf)]).collect()
    assert sorted(r.value for r in inside if r.slot == 0) == [0.0] * 4 + [2.0] * 2 + [inf] * 2 and not [r for r in inside if r.slot == 1]
    assert "MapInArrow" in plan(quantiles._inside(df, [("v0", 0.0, 1.0)])) and len([r for r in inside if r.slot == 2]) == 8


def test_outlier_limits_are_literals(spark):
    text = plan(stats.outlier_rows(spark.read.parquet(f"{SF_DIR}/events.parquet"), "value"))
    assert "Exchange" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize("name", ["c09_duplicate_rows", "e06_duplicate_count", "f03_value_counts", "f12_share_by_category", "g06_outlier_rows",
                                  "i02_fill_missing_mode", "i05_undo_fill", "j07_score_relevance", "t05_trend_by_date"])
def test_no_cartesian_products(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_copies_are_counted_before_the_shuffle(spark):
    text = plan(QUERIES["c09_duplicate_rows"](spark, SF_DIR))
    assert re.search(r"hashpartitioning\(_h1#\d+L?, _h2", text)                        # rows are counted by their hashes
    assert "partial" in text or text.count("HashAggregate") >= 2


def test_questions_are_scored_without_a_shuffle(spark):
    for name in ("j01_normalize_questions", "j05_cosine_to_context", "j07_score_relevance", "j08_route_question"):
        assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


def test_no_long_text_is_shuffled_to_be_counted(spark):
    """Distinct counts shuffle digests of long texts; a text column with many values is refused without an exchange of its values."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text")
    text = plan(quality.distinct_counts(docs))
    keys = [k for k in re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text) if k]
    assert keys and "sha2" in text and all("text#" not in k for k in keys)
    assert "Exchange" not in plan(segments.category_table(docs, ["text"]))


def test_library_keeps_rows_off_the_driver():
    """No base table goes through pandas, RDDs, local checkpoints or an unnamed cross join."""
    root = pathlib.Path(__file__).parent.parent / "tabulight"
    source = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)
    for word in ("toPandas", "crossJoin", "localCheckpoint", ".rdd", "toLocalIterator", "udf(", "mkdtemp", ".checkpoint("):
        assert word not in source
