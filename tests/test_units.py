"""Edge cases on small frames; expected values are worked out by hand."""

import random

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from tabulight.functions.columns import is_missing
from tabulight.operators import (
    filters, findings, quality, questions, repair, rows, schema, segments, stats, timeseries,
)
from tabulight.plans.quantiles import quantiles
from tabulight.plans.ranking import with_position
from tabulight.sources import cleaning, delimited, writers


def by(frame, key="column"):
    return {r[key]: r.asDict() for r in frame.collect()}


def numbers(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


# --- reading and cleaning ------------------------------------------------------------

def test_ragged_file_keeps_short_and_drops_long_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a;b;c\n1;2;3\n4;5\n6;7;8;9\n"x;y";N/A;-\n;;\n')
    got = [tuple(r) for r in delimited.read_delimited(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [("1", "2", "3"), ("4", "5", None), ("x;y", None, None), (None, None, None)]


def test_encoding_is_detected_per_file(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("a,b\ncafé,1\n".encode())
    (tmp_path / "l.csv").write_bytes("a,b\nthé,2\n".encode("latin-1"))
    got = {tuple(r) for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {("café", "1"), ("thé", "2")}


@pytest.mark.parametrize("text,sep", [("a\tb\n", "\t"), ("a,b;c,d\n", ","), ("plain\n", "\t"), ("a|b|c,d\n", "|"), ("a,b;c\n", ",")])
def test_sniffing(spark, tmp_path, text, sep):
    (tmp_path / "f.txt").write_text(text)
    assert delimited.sniff_delimiter(spark, str(tmp_path / "f.txt")) == sep


def test_unreadable_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delimited.sniff_delimiter(spark, str(tmp_path / "missing.txt"))


def test_names_are_clean_and_unique_ignoring_case():
    assert cleaning.clean_names([" Total $ ", "a b", "a_b", "", "A_B", "null", "a_b_1"]) == [
        "Total", "a_b", "a_b_1", "column_3", "A_B_2", "column_5", "a_b_1_1"]


def test_coercion_needs_every_value(spark):
    df = spark.createDataFrame([("1", "1", "1d"), (" 2.5 ", "x", "2"), (None, "3", "3")], "a string, b string, c string")
    assert cleaning.coerce_numeric(df).dtypes == [("a", "double"), ("b", "string"), ("c", "string")]


def test_clean_table_drops_empty_parts(spark):
    df = spark.createDataFrame([(" x\t", None, None), (None, None, None), ("nan", None, 1)], "a string, b string, c int")
    assert set(map(tuple, cleaning.clean_table(df).collect())) == {(None, 1), ("x", None)}


# --- types ---------------------------------------------------------------------------

def types_of(spark, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return schema.semantic_types(df)["c"]


@pytest.mark.parametrize("values,expected", [
    (["Yes", "no"], "BOOL"), (["yes", "Yes ", "no"], "BOOL"), (["yes", "Yes", "no", "No"], "TEXT"), (["yes"], "TEXT"),
    ([None, None], "TEXT"), (["1"] * 9 + ["x"], "NUM"), (["1", "2"] * 4 + ["x"] * 2, "MIXED"),
    (["1"] + ["x", "y", "z", "w"], "MIXED"), (["1", "x", "y", "z"], "TEXT"), (["1"] + ["x"] * 5, "TEXT"),
    (["2020-1-05"] * 4 + ["?"], "DATE"), (["2020-01-05"] * 3 + ["?"] * 2, "TEXT"),
    (["05/01/2020", "25/01/2020", "26/01/2020"], "DATE"), (["20200105", "20200106"], "NUM"),
    (["5 Jan 2020", "6 Feb 2020"], "DATE"), (["January 5, 2020"], "DATE"), (["1,000", "2,000"], "TEXT"),
])
def test_text_types(spark, values, expected):
    assert types_of(spark, values) == expected


def test_native_types(spark):
    assert types_of(spark, [0, 1, None], "int") == "BOOL"
    assert types_of(spark, [1, 1], "int") == "NUM"
    assert types_of(spark, [0.0, 1.0], "double") == "NUM"
    assert types_of(spark, [True], "boolean") == "BOOL"
    assert types_of(spark, [], "string") == "TEXT"


def test_classes_need_ten_values(spark):
    nine = spark.createDataFrame([(str(i) if i < 9 else "x",) for i in range(20)], "c string")
    ten = spark.createDataFrame([(str(i) if i < 10 else "x",) for i in range(20)], "c string")
    assert schema.column_classes(nine)["categorical"] == ["c"]
    assert schema.column_classes(ten)["numeric"] == ["c"]


def test_sample_is_repeatable(spark):
    df = spark.range(5000)
    one = {r[0] for r in schema.sample_rows(df, 100, ["id"]).collect()}
    two = {r[0] for r in schema.sample_rows(df.repartition(7), 100, ["id"]).collect()}
    assert one == two and len(one) == 100
    assert schema.sample_rows(df, 9000, ["id"]).count() == 5000
    copies = spark.range(1000).select((F.col("id") % 2).alias("k"))
    assert schema.sample_rows(copies, 300, ["k"]).count() == 300


# --- filters and rows ----------------------------------------------------------------

def test_filter_specifications(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "the_key int, t string")
    ids = lambda f: [r[0] for r in filters.apply_filters(df, f).orderBy("the_key").collect()]
    assert ids({}) == ids({"nope": 1}) == ids({"t": "none"}) == ids({"t": ["None", "", None]}) == ids({"t": {"start": "", "end": None}}) == [1, 2, 3]
    assert ids({"THE KEY": [2]}) == [2] and ids({"the_key": {"start": 2}}) == [2, 3] and ids({"the_key": [1, 3], "t": "a"}) == [1]
    assert filters.cross_filter({"a": 1}, "b", 2) == {"a": 1, "b": [2]} and filters.cross_filter({"a": 1}, "a") == {}


@pytest.mark.parametrize("sql", [
    "DROP TABLE dataset", "WITH x AS (SELECT 1) INSERT INTO dataset SELECT 1", "SELECT 1", "SELECT 'drop' FROM dataset",
    "WITH dataset AS (SELECT 1) MERGE INTO t USING dataset ON true", "SET a=1", "",
    "SELECT TRANSFORM(id) USING 'cat' FROM dataset", "SELECT reflect('java.lang.System', 'exit') FROM dataset"])
def test_user_sql_is_refused(spark, sql):
    with pytest.raises(filters.RejectedQuery):
        filters.sql_readonly(spark, sql, dataset=spark.range(1))


def test_user_sql_must_analyse(spark):
    with pytest.raises(Exception, match="no_such"):
        filters.sql_readonly(spark, "SELECT no_such FROM dataset", dataset=spark.range(1))


def test_search_wildcards_and_blank(spark):
    df = spark.createDataFrame([("Abc", 1), ("xyz", 2), (None, 3)], "t string, n int")
    kinds = {"t": "TEXT", "n": "NUM"}
    assert filters.search_text(df, "B", kinds).count() == 1
    assert filters.search_text(df, "a_c", kinds).count() == 1
    assert filters.search_text(df, "", kinds).count() == 3
    assert filters.search_text(df, "\\", kinds).count() == 0


def test_json_safe(spark):
    got = filters.json_safe(numbers(spark, [1.0, float("nan"), float("inf"), float("-inf"), None])).collect()
    assert [r[0] for r in got] == [1.0, None, None, None, None]


def test_duplicate_rows_restores_every_copy(spark, monkeypatch):
    monkeypatch.setattr(rows, "COPIES_PER_ROW", 7)
    df = spark.createDataFrame([(1, None)] * 50 + [(2, "b")] * 2 + [(3, "c")], "a int, b string")
    got = rows.duplicate_rows(df).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"], r["count"]) for r in got} == {(1, None, 50), (2, "b", 2)}


def test_sample_values_cut_only_what_is_shown(spark):
    long = "x" * 150
    df = spark.createDataFrame([(long + "b", 2.5), (long + "a", None), ("a", 1.5), (None, float("nan"))], "t string, d double")
    got = {(r["column"], r["rank"]): r["sample"] for r in rows.sample_values(df).collect()}
    assert got == {("t", 1): "a", ("t", 2): "x" * 100 + "...", ("t", 3): "x" * 100 + "...", ("d", 1): "1.5", ("d", 2): "2.5"}


def test_pages_and_sorting(spark):
    df = spark.range(45)
    assert [r[0] for r in rows.page(df, 3, 20, "id", "DESC").collect()] == [4, 3, 2, 1, 0]
    assert rows.sort_by(df, "nope") is df
    assert [r[0] for r in rows.page(df, 0, 2, "id").collect()] == [0, 1]


# --- quality -------------------------------------------------------------------------

def test_missing_levels(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", " ", "\t", "nan", "None", "N/A", "undefined", "x")], "c string")
    found = lambda level: df.where(is_missing(df, "c", level)).count()
    assert [found(m) for m in ("M0", "M1", "M2", "M3")] == [1, 3, 5, 8]


def test_missing_severity_limits(spark):
    df = spark.createDataFrame([(None if i < 20 else 1, None if i < 21 else 1, None if i < 5 else 1, None if i < 6 else 1)
                                for i in range(100)], "a int, b int, c int, d int")
    assert {k: r["severity"] for k, r in by(quality.missing_profile(df)).items()} == {"a": "MEDIUM", "b": "HIGH", "c": "LOW", "d": "MEDIUM"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, t string, x double")
    assert quality.missing_totals(df).first().asDict() == {
        "missing_cells": 0, "missing_pct": 0.0, "null_cells": 0, "null_pct": 0.0, "columns_with_missing": 0}
    assert quality.duplicate_count(df).first()["duplicates"] == 0
    assert quality.quality_label(df).first()["label"] == "EXCELLENT"
    assert stats.stat_summary(df, ["a", "x"]).collect() == []
    assert stats.iqr_outliers(df, ["a", "x"]).collect() == []
    assert {r["distinct_count"] for r in quality.distinct_counts(df).collect()} == {0}
    assert [r["rule"] for r in findings.dashboard_findings(df, {"a": "NUM", "t": "TEXT", "x": "NUM"}).collect()] == ["no data"]


def test_nan_is_missing_everywhere(spark):
    df = numbers(spark, [float("nan"), 1.0, 1.0, float("nan")])
    assert quality.null_counts(df).first()["nulls"] == 2
    assert quality.distinct_counts(df).first()["distinct_count"] == 1
    assert quality.duplicate_count(df).first()["duplicates"] == 2
    assert by(quality.empty_and_constant(df))["v"]["kind"] == "constant"


def test_mixed_text_and_padding(spark):
    df = spark.createDataFrame([("-1.5", "a"), ("x", " a"), ("1-2-3", "b"), ("", "b")], "m string, p string")
    assert {(r["column"], r["issue"]) for r in quality.mixed_and_whitespace(df).collect()} == {("m", "mixed types"), ("p", "outer whitespace")}


def test_key_fields_prefers_named_id(spark):
    df = spark.createDataFrame([(i, i % 3, f"2020-01-{i:02d}", float(i)) for i in range(1, 20)], "customer_id int, grp int, created_at string, amount double")
    got = {(r["role"], r["column"]) for r in quality.key_fields(df, {"customer_id": "NUM", "grp": "NUM", "created_at": "DATE", "amount": "NUM"}).collect()}
    assert got == {("id", "customer_id"), ("date", "created_at"), ("measure", "grp"), ("measure", "amount")}


def test_trust_score_small_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    row = quality.trust_score(df, {"a": "NUM", "b": "TEXT"}).first()
    # a third of the cells is NULL (20), a third of the rows repeats (10), fewer than 30 rows (20)
    assert (row["score"], row["band"], row["flags"]) == (50, "poor", ["nulls: b", "duplicate rows"])


def test_forecast_safety(spark):
    dates = lambda n, d: spark.createDataFrame([(f"2020-01-{i % d + 1:02d}",) for i in range(n)], "d string")
    reason = lambda df, t="DATE": quality.forecast_safety(df, {"d": t}).first()["reason"]
    assert [reason(dates(20, 5)), reason(dates(9, 5)), reason(dates(20, 3)), reason(dates(20, 5), "TEXT")] == [
        "ok", "too few rows", "too few periods", "no date column"]


def test_catalog_lists_values_up_to_thirty(spark):
    df = spark.createDataFrame([(f"v{i:02d}", f"w{i % 30:02d}") for i in range(31)], "many string, few string")
    got = by(quality.catalog_profile(df))
    assert got["many"]["values"] is None and got["few"]["values"] == [f"w{i:02d}" for i in range(30)]


# --- statistics ----------------------------------------------------------------------

def test_quartiles_interpolate(spark):
    assert stats.quartiles(numbers(spark, [1.0, 2.0, 3.0, 10.0]), ["v"]) == {"v": [1.75, 2.5, 4.75]}
    assert stats.quartiles(numbers(spark, [None, None]), ["v"]) == {"v": [None, None, None]}
    assert stats.quartiles(numbers(spark, [7.0]), ["v"]) == {"v": [7.0, 7.0, 7.0]}


@pytest.mark.parametrize("values", [
    [float(i) for i in range(1000)], [float(i % 3) for i in range(1000)], [5.0] * 900 + [float(i) for i in range(100)],
    [1.0] * 500 + [2.0] * 500, [2.0 ** (i % 200 - 100) for i in range(997)], [float("inf")] * 3 + [float("-inf")] * 3 + [0.0] * 5,
    [0.0] * 499 + [i / 100 for i in range(1, 100)] + [1.0] * 499,
])
def test_quantiles_with_tiny_fences(spark, values):
    import numpy as np

    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(numbers(spark, values), ["v"], probs, lambda c: c, small_rows=10, fence_rows=5)["v"]
    ordered = sorted(values)
    for p, g in zip(probs, got):
        place = p * (len(ordered) - 1)
        a, b = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        np.testing.assert_equal(g, a if a == b else a + (b - a) * (place - np.floor(place)))


def test_mode_tie_takes_the_smallest(spark):
    row = stats.stat_summary(numbers(spark, [3.0, 1.0, 1.0, 3.0]), ["v"]).first()
    assert (row["mode"], row["skewness"], row["mean"]) == (1.0, "Normal", 2.0)


def test_zero_and_negative_mean_have_low_variability(spark):
    assert stats.stat_summary(numbers(spark, [-5.0, 5.0]), ["v"]).first()["variability"] == "Low"
    assert stats.stat_summary(numbers(spark, [-1.0, -9.0]), ["v"]).first()["variability"] == "Low"


def test_outliers_need_enough_values(spark):
    nine = numbers(spark, [float(i) for i in range(8)] + [1000.0])
    ten = numbers(spark, [float(i) for i in range(9)] + [1000.0])
    assert stats.iqr_outliers(nine, ["v"]).count() == 0 and stats.iqr_outliers(ten, ["v"]).first()["total_outliers"] == 1
    flat = numbers(spark, [5.0] * 9 + [6.0])
    assert stats.iqr_outliers(flat, ["v"]).count() == 1 and stats.iqr_outliers_basic(flat, ["v"]).count() == 0


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, None), (2.0, 4.0, 7.0, 1.0), (3.0, 6.0, 7.0, 0.0), (4.0, 8.0, 7.0, None)],
                               "x double, y double, const double, gaps double")
    r = {(a["var1"], a["var2"]): a["r"] for a in stats.correlation_matrix(df, df.columns).collect()}
    assert r[("x", "y")] == r[("y", "x")] == r[("x", "x")] == 1.0 and r[("x", "const")] is None and r[("x", "gaps")] == -1.0
    assert len(r) == 16


def test_correlation_of_many_columns_equals_that_of_few(spark):
    """Ten columns go through matrices, three of them through aggregates; NULLs, constants, infinite values and an empty table."""
    draw = random.Random(3)
    data = [[draw.random() if draw.random() < 0.8 else None for _ in range(8)] + [5.0, draw.choice([1.0, float("inf")])] for _ in range(200)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(10))).repartition(5)
    wide = {(a["var1"], a["var2"]): a["r"] for a in stats.correlation_matrix(df, df.columns).collect()}
    assert len(wide) == 100 and wide["c0", "c0"] == 1.0
    assert all(r is None for pair, r in wide.items() if {"c8", "c9"} & set(pair))
    for few in (["c0", "c1", "c2"], ["c3", "c8", "c9"]):
        narrow = {(a["var1"], a["var2"]): a["r"] for a in stats.correlation_matrix(df, few).collect()}
        assert narrow == {pair: wide[pair] for pair in narrow} and len(narrow) == 9
    for i, j in ((0, 1), (2, 7)):
        both = np.array([(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None])
        assert wide[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=6e-5)
    empty = stats.correlation_matrix(df.limit(0), df.columns).collect()
    assert len(empty) == 100 and all(r["r"] is None for r in empty)


@pytest.mark.parametrize("sort, direction", [("k", "ASC"), ("k", "DESC"), ("v", "DESC"), ("v", "ASC"), ("s", "ASC"), ("raw", "DESC")])
def test_deep_pages_equal_a_sorted_list(spark, monkeypatch, sort, direction):
    """NULL and NaN keys, a value that fills half the table, and pages across and beyond the end."""
    monkeypatch.setattr(rows, "PAGED_ROWS", 20)
    draw = random.Random(5)
    data = [(i, draw.choice([None, 1, 1, 1, draw.randrange(50)]), draw.choice([None, float("nan"), -0.0, 0.0, draw.random()]),
             draw.choice([None, "", "é", "z" * draw.randrange(9)]), bytes([draw.randrange(9)])) for i in range(700)]
    df = spark.createDataFrame(data, "id int, k int, v double, s string, raw binary").repartition(4)
    ordered = [r["id"] for r in rows.sort_by(df, sort, direction, ["id"]).collect()]
    for number, size in ((2, 30), (5, 100), (12, 60), (7, 100), (30, 100)):
        got = [r["id"] for r in rows.page(df, number, size, sort, direction, ["id"]).collect()]
        assert got == ordered[(number - 1) * size:number * size]


def test_deep_page_of_equal_keys_is_whole(spark, monkeypatch):
    monkeypatch.setattr(rows, "PAGED_ROWS", 20)
    df = spark.range(300).selectExpr("id", "if(id % 10 = 0, 2, 1) as k")
    assert {r["k"] for r in rows.page(df, 5, 50, "k").collect()} == {1} and rows.page(df, 6, 50, "k").count() == 50
    assert rows.page(df.limit(0), 5, 50, "k").count() == 0


def test_dates_always_fit_the_points(spark):
    """Days, weeks, months, years and larger units; each row in a point, whatever the span."""
    for days, label in ((10, "2000-01-01"), (60, "1999-12-27"), (400, "2000-01"), (4000, "2000"), (14600, "2000"), (60000, "2000")):
        df = spark.sql(f"select date_add(date'2000-01-01', cast(id as int)) as d, 1.0 as v from range({days}) union all select null, 1.0")
        got = segments.series(df, {"d": "DATE", "v": "NUM"}, "v", "d").collect()
        assert len(got) <= 15 and sum(r["value"] for r in got) == days + 1
        assert got[0]["label"] == "Null" and got[1]["label"] == label


def test_primary_metric(spark):
    df = spark.createDataFrame([(i, i * 10.0, 1) for i in range(6)], "a int, b double, c int")
    assert stats.primary_metric(df, ["a", "b", "c"]) == "b" and stats.primary_metric(df, []) is None
    assert stats.primary_metric(df.withColumnRenamed("c", "unit_price"), ["a", "b", "unit_price"]) == "unit_price"
    assert stats.primary_metric(df.limit(3), ["a", "b"]) == "a"


def test_signed_names_may_be_negative(spark):
    df = spark.createDataFrame([(-1, -1)] * 5, "balance int, other int")
    assert [r["column"] for r in stats.negative_share(df, ["balance", "other"]).collect()] == ["other"]


def test_anomalies_on_one_row(spark):
    assert stats.anomalies(numbers(spark, [1.0]), ["v"], []).count() == 0


# --- time ----------------------------------------------------------------------------

def dated(spark, rows_):
    return spark.createDataFrame(rows_, "d string, v double")


def test_month_changes_skip_missing_months_and_zero(spark):
    df = dated(spark, [("2020-01-05", 0.0), ("2020-02-05", 10.0), ("2020-05-01", 5.0), ("2020-06-01", 5.0), ("bad", 1.0), ("2020-06-02", None)])
    got = [(r["period"], r["change_pct"], r["direction"]) for r in timeseries.mom_changes(df, "d", "v").orderBy("period").collect()]
    assert got == [("2020-02", 0.0, "flat"), ("2020-05", -50.0, "down"), ("2020-06", 0.0, "flat")]


def test_trend_needs_rows_and_months(spark):
    months = lambda m, per: dated(spark, [(f"2020-{i + 1:02d}-01", float(i)) for i in range(m) for _ in range(per)])
    assert timeseries.trend(months(2, 10), "d", "v").count() == 0 and timeseries.trend(months(3, 4), "d", "v").count() == 0
    row = timeseries.trend(months(3, 5), "d", "v").first()
    assert (row["direction"], row["strength"], row["slope"], row["periods"]) == ("upward", "moderate", 1.0, 3)
    flat = timeseries.trend(dated(spark, [(f"2020-0{i % 4 + 1}-01", 2.0) for i in range(20)]), "d", "v").first()
    assert (flat["direction"], flat["strength"]) == ("downward", "slight")


def test_one_month_gives_no_spikes(spark):
    assert timeseries.trend_report(dated(spark, [("2020-01-01", 1.0)] * 30), ["d"], ["v"]).count() == 0
    assert stats.period_spikes(dated(spark, [("2020-01-01", 1.0)] * 30), "d", ["v"]).count() == 0


def test_positions_across_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r["k"]: r["position"] for r in with_position(df, "k", F.col("k").cast("double"), bucket_rows=37).collect()}
    assert got == {i: i for i in range(1000)}


# --- segments and findings -----------------------------------------------------------

@pytest.mark.parametrize("n,kept", [(1, False), (2, True), (50, True), (51, False)])
def test_category_limits(spark, n, kept):
    df = spark.createDataFrame([(f"c{i}",) for i in range(n)], "c string")
    assert (segments.concentration(df, "c").count() == 1) == kept


@pytest.mark.parametrize("counts,level", [((40, 20, 10, 15, 15), "High"), ((40, 20, 10, 10, 10, 10), "Medium"), ((14, 13, 13, 12, 12, 12, 12, 12), "Low")])
def test_concentration_levels(spark, counts, level):
    df = spark.createDataFrame([(f"c{i}",) for i, k in enumerate(counts) for _ in range(k)], "c string")
    assert segments.concentration(df, "c").first()["concentration"] == level


def test_share_chart_switches_at_seven_groups(spark):
    make = lambda n: spark.createDataFrame([(f"c{i:02d}" if i else None, float(i + 1)) for i in range(n)], "c string, v double")
    shares = lambda n: {r["label"]: (r["kind"], r["value"]) for r in segments.share_by_category(make(n), "c", "v").collect()}
    assert shares(1) == {} and shares(6)["Null"] == ("pie", 1.0) and shares(7)["Null"] == ("bar", 1.0)
    assert "Others" not in shares(10) and shares(12)["Others"] == ("bar", 3.0) and len(shares(12)) == 11


def test_stacked_matrix_limits(spark):
    make = lambda n: spark.createDataFrame([(f"d{i % 3}", f"c{i % n}", 1.0) for i in range(30)], "d string, c string, v double")
    assert segments.stacked_matrix(make(6), "d", "c", "v").count() == 0
    assert segments.stacked_matrix(make(2), "d", "c", "v").columns == ["date", "c0", "c1"]


def test_scatter_needs_more_than_five_rows(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 2 else 1.0) for i in range(6)], "k int, x double, y double")
    assert segments.scatter_points(df, "x", "y", ["k"]).count() == 5
    assert segments.scatter_points(df.limit(5), "x", "y", ["k"]).count() == 0


def test_recommendation_fallback(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    got = findings.recommendations(df, {"numeric": [], "date": [], "categorical": ["c"]}).collect()
    assert [tuple(r) for r in got] == [("Exploration", "dataset", "LOW")]


def test_dashboard_summary_when_nothing_fires(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(30)], "a int, t string")
    got = [(r["rule"], r["value"]) for r in findings.dashboard_findings(df, {"a": "NUM", "t": "TEXT"}).collect()]
    assert got == [("summary", 30.0)]


# --- repair --------------------------------------------------------------------------

def test_fill_errors(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    for method, custom in (("mean", None), ("median", None), ("custom", " "), ("bogus", None)):
        with pytest.raises(ValueError):
            repair.fill_missing(df, "t", method, custom, {"t": "TEXT"})


def test_fill_null_clears_blank_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, "None")], "k int, t string")
    got = repair.fill_missing(df, "t", "null", schema={"t": "TEXT"}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", False, None), (2, None, True, " "), (3, None, True, "None")]


def test_dollar_signs_are_text(spark):
    spark.conf.set("my.word", "X")
    df = spark.createDataFrame([("${my.word}",), ("A",), ("B",)], "c string")
    assert [r["sample"] for r in rows.sample_values(df).orderBy("rank").collect()] == ["${my.word}", "A", "B"]
    assert filters.sql_readonly(spark, "SELECT count(*) AS n FROM t", t=df).first()["n"] == 3


def test_user_sql_reads_the_given_views_only(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    df.write.parquet(str(tmp_path / "other"))
    for text in (f"SELECT * FROM parquet.`{tmp_path}/other`, data", "SELECT * FROM data WHERE k IN (SELECT k FROM elsewhere)", "WITH a AS (SELECT * FROM b) SELECT * FROM a, data"):
        with pytest.raises(filters.RejectedQuery):
            filters.sql_readonly(spark, text, data=df)
    spark.range(7).createOrReplaceTempView("data")
    assert filters.sql_readonly(spark, "WITH a AS (SELECT k FROM data) SELECT * FROM a JOIN data USING (k)", data=df).count() == 1
    assert spark.table("data").count() == 7            # the session's own view is back
    spark.catalog.dropTempView("data")


def test_dates_of_a_column_have_one_format(spark):
    df = spark.createDataFrame([(f"{m:02d}/{d:02d}/2024", 1.0) for m in range(1, 13) for d in (3, 4, 25)], "day string, v double")
    months = timeseries.monthly(df, "day", "v").collect()
    assert [(r["month"], r["count"]) for r in months] == [(f"2024-{m:02d}", 3) for m in range(1, 13)]


@pytest.mark.parametrize("text", ["2024-01-05T10:00:00", "2024-01-05 10:00", "2024-01-05T10:00:00.123456Z", "2024-01-05 11:00:00+01:00", "5/1/2024 10:00 AM"])
def test_times_are_dates(spark, text):
    df = spark.createDataFrame([(text, 1.0)] * 12, "at string, v double")
    assert schema.semantic_types(df)["at"] == "DATE" and timeseries.monthly(df, "at", "v").first()["month"] == "2024-01"


def test_quoted_cells_and_mixed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,  pad  \n')
    (tmp_path / "b.csv").write_bytes("t;k\nc\u00e9;4\n".encode("latin-1"))
    got = {r["k"]: r["t"] for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {"1": 'say "hi", ok', "2": "two\nlines", "3": "  pad  ", "4": "c\u00e9"}


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_line_breaks_in_cells_are_read_split_by_split(spark, tmp_path, eol):
    """As one task reads them, also where splits end within a record, and one record spans several splits."""
    draw = random.Random(3)
    cells = ["x", "", '5" pipe', '"a, b"', '"two\nlines"', '"say ""hi""\n\n""there"""', '"q\n"', '""', '"x" tail']
    row = lambda i: f"{i},{draw.choice(cells)},{draw.choice(cells)}"
    lines = ["k,t,u", *map(row, range(1500)), '-1,"long ' + "z\n" * 3000 + 'end",u', *map(row, range(1500, 2000)), "3", "", '4,"open\nto the end']
    (tmp_path / "f.csv").write_bytes("\n".join(lines).replace("\n", eol).encode())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        (layout,) = delimited.layouts(spark, str(tmp_path))
        got = delimited.read_delimited(spark, str(tmp_path), sentinels=False)
        tasks, found = delimited.records(spark, [str(tmp_path)], layout), sorted(map(repr, got.collect()))
        used = tasks.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path))
    assert layout.multi_line and used > 8 and found == sorted(map(repr, whole.collect())) and len(found) == 2003


@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=12), st.booleans())
def test_states_of_lines(ways, start):
    state, plain = start, [start]
    for outside, inside in ways:
        state = inside if state else outside
        plain.append(state)
    assert delimited._states(np.array([w[0] for w in ways], bool), np.array([w[1] for w in ways], bool), start).tolist() == plain


def test_a_lone_quote_leaves_a_file_to_many_tasks(spark, tmp_path):
    lines = ["k,t", *(f'{i},{i}" pipe' if i % 1000 == 7 else f'{i},"quoted, ""{i}"""' for i in range(20_000))]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (layout,) = delimited.layouts(spark, str(tmp_path))
    assert not layout.multi_line and layout.separator == ","
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = delimited.read_delimited(spark, str(tmp_path))
        found = {r["k"]: r["t"] for r in read.collect()}
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(found) == 20_000 and found["7"] == '7" pipe' and found["8"] == 'quoted, "8"'


@pytest.mark.parametrize(("line", "separator", "is_open"), [
    ('a,"b', ",", True), ('"a', ",", True), ('a,"b""', ",", True), ('a,"b","c', ",", True), ('a,"b"', ",", False), ('"a","b","c"', ",", False), ('"a ""b""",c', ",", False),
    ('a,5" pipe', ",", False), ('a;"b', ",", False), ('a;"b', ";", True), ('a|"b', "|", True), ('a|"b"|c', "|", False), ('a\t"b', "\t", True), ('"",""', ",", False), ('""",a', ",", True)])
def test_lines_that_leave_a_cell_open(spark, line, separator, is_open):
    assert spark.createDataFrame([(line,)], "value string").select(delimited._leaves_open(separator)).first()[0] is is_open


@pytest.mark.parametrize("text", [
    "WITH secret AS (SELECT * FROM secret) SELECT secret.* FROM secret, data",
    "WITH a AS (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret) SELECT a.* FROM a, data",
    "SELECT * FROM data WHERE k IN (WITH secret AS (SELECT k FROM secret) SELECT k FROM secret)",
    "WITH data2 AS (SELECT * FROM data), secret AS (SELECT s.* FROM secret s) SELECT * FROM data2, secret"])
def test_a_with_name_opens_no_foreign_view(spark, text):
    spark.range(3).withColumnRenamed("id", "k").createOrReplaceTempView("secret")
    data = spark.createDataFrame([(1, "a")], "k bigint, t string")
    with pytest.raises(filters.RejectedQuery):
        filters.sql_readonly(spark, text, data=data)
    spark.catalog.dropTempView("secret")
    over = spark.range(2).withColumnRenamed("id", "k")
    over.createOrReplaceTempView("inner_view")
    own = spark.table("inner_view").where("k >= 0")                    # a given view may itself read others
    ok = "WITH data AS (SELECT k FROM data) SELECT count(*) AS n FROM data WHERE k IN (SELECT max(k) FROM data) UNION ALL SELECT 1"
    assert filters.sql_readonly(spark, ok, data=own).count() == 2
    spark.catalog.dropTempView("inner_view")


def test_columns_with_few_values_are_never_refused(spark):
    rows = spark.range(20_000).selectExpr("id % 50 AS a", "id % 51 AS b", "concat('text number ', id) AS c", "cast(id % 2 as string) AS d", "cast(id as double) AS m")
    found = segments.category_table(rows, ["a", "b", "c", "d"], "m")
    assert {(r["column"], r["values"]) for r in found.select("column", "values").distinct().collect()} == {("a", 50), ("d", 2)}
    assert segments._admitted(rows, ["a", "c", "d"], 50) == ["a", "d"] and segments._admitted(rows, [], 50) == []


def test_distinct_long_texts(spark):
    long = "x" * 40
    rows = spark.createDataFrame([(long,), (long,), (long + "y",), ("x",), (None,), ("",), ("X" * 32,)], "t string")
    assert quality.distinct_counts(rows).first()["distinct_count"] == 5


def test_undo_restores_only_marked_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "a")], "k int, t string")
    filled = repair.fill_missing(df, "t", "custom", "a")
    assert sorted(map(tuple, repair.undo_fill(filled, "t").collect())) == [(1, "a"), (2, " "), (3, None), (4, "a")]


# --- questions -----------------------------------------------------------------------

def ask(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_normalisation_side_effects(spark):
    got = [r["normalized"] for r in questions.normalize_questions(ask(
        spark, "Total SALES?", "top ten", "line chart", "How many items", "how  many", "Été: mean", "twenty-one")).collect()]
    assert got == ["count sales", "highest 10", "rows chart", "count rows", "how many", "été average", "20 1"]


def test_routes(spark):
    got = [(r["op_code"], r["n"]) for r in questions.route_question(ask(
        spark, "How many rows", "top 25 prices", "show me the first", "any duplicates", "blank cells", "unique names", "max price",
        "least price", "avg price", "price of tea", "hm", "")).collect()]
    assert got == [("count", 10), ("top", 25), ("head", 10), ("duplicates", 10), ("missing", 10), ("distinct", 10), ("highest", 10),
                   ("lowest", 10), ("average", 10), ("search", 10), ("preview", 10), ("preview", 10)]


def test_relevance_rules(spark):
    kinds = {"unit_price": "NUM", "city": "TEXT"}
    got = {r["text"]: (r["rule"], r["decision"]) for r in questions.score_relevance(ask(
        spark, "Go on", "mean", "please display it", "sort by city", "tell me a joke", "city unit price", "lorem ipsum", "describe unit price city"),
        kinds).collect()}
    assert got["Go on"] == ("follow-up", "accept") and got["mean"] == ("follow-up", "accept")
    assert got["please display it"] == ("show data", "accept") and got["sort by city"] == ("data pattern", "accept")
    assert got["tell me a joke"] == ("off topic", "reject") and got["lorem ipsum"] == ("score", "reject")
    assert got["city unit price"][0] == "score" and got["describe unit price city"] == ("score", "accept")


def test_answers(spark):
    df = spark.createDataFrame([(3, "red wine", 5.0), (1, "white wine", 9.0), (2, "beer", 1.0)], "k int, name string, price double")
    kinds = {"k": "NUM", "name": "TEXT", "price": "NUM"}
    run = lambda q: [tuple(r) for r in questions.answer(df, q, ["k"], kinds).collect()]
    assert run("how many?") == [(3,)]
    assert run("top 2") == [(3, "red wine", 5.0), (2, "beer", 1.0)]
    assert run("first rows") == [(1, "white wine", 9.0), (2, "beer", 1.0), (3, "red wine", 5.0)]
    assert run("anything about beer") == [(2, "beer", 1.0)]
    assert run("zz") == run("first rows") and run("lowest")[0] == (1, "white wine")
    assert sorted(run("average")) == [("k", 2.0), ("price", 5.0)]


# --- sinks ---------------------------------------------------------------------------

def test_json_has_no_nan(spark, tmp_path):
    writers.write_json(numbers(spark, [1.0, float("nan")]), str(tmp_path / "j"))
    lines = [ln for f in (tmp_path / "j").glob("*.json") for ln in f.read_text().splitlines()]
    assert sorted(lines) == ['{"v":1.0}', '{"v":null}']


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.export_cleaned(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_malformed_lines_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    import glob

    from checks import ingest, load

    monkeypatch.setattr(ingest, "new_folder", lambda session, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = {r.what: r.n for r in load().QUERIES["a01_rejected"](spark, "/root/testdata/sf0.01").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"rejected": 1500, "read": 13500} and len(glob.glob(f"{tmp_path}/long/part-*")) > 1
