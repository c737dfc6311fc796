"""Laws that hold for any table."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tabulight.operators import quality, repair, rows, segments, stats

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
CELL = st.one_of(st.none(), st.sampled_from(["", " ", "nan", "a", "b", "c"]))
TABLE = st.lists(st.tuples(CELL, st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=25)
NUMBERS = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=40)


@FEW
@given(TABLE)
def test_copies_and_counts(spark, data):
    df = spark.createDataFrame(data, "t string, n int")
    kinds = Counter(data)
    facts = quality.duplicate_count(df).first()
    assert (facts["rows"], facts["duplicates"]) == (len(data), len(data) - len(kinds))
    assert Counter(map(tuple, rows.duplicate_rows(df).collect())) == Counter({k: n for k, n in kinds.items() if n > 1})
    counted = segments.value_counts(df, "t", 10).where("`end` = 'top'").collect()
    assert sum(r["count"] for r in counted) == sum(a is not None for a, _ in data)


@FEW
@given(TABLE, st.sampled_from(["mode", "custom", "null"]))
def test_undo_restores_the_table(spark, data, method):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "k int, t string, n int")
    filled = repair.fill_missing(df, "t", method, "x", {"t": "TEXT"})
    assert sorted(map(tuple, repair.undo_fill(filled, "t").collect())) == [(i, *r) for i, r in enumerate(data)]


@FEW
@given(NUMBERS)
def test_quartiles_match_the_definition(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got, kept = stats.quartiles(df, ["v"])["v"], sorted(v for v in data if v is not None)
    for p, q in zip((0.25, 0.5, 0.75), got):
        if not kept:
            assert q is None
            continue
        place = p * (len(kept) - 1)
        low = kept[int(place)]
        high = kept[min(int(place) + 1, len(kept) - 1)]
        assert q == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12, abs=1e-9)


@FEW
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.integers(-9, 9)), min_size=2, max_size=30))
def test_correlation_is_bounded_and_symmetric(spark, data):
    df = spark.createDataFrame(data, "x int, y int")
    r = {(a["var1"], a["var2"]): a["r"] for a in stats.correlation_matrix(df, ["x", "y"]).collect()}
    assert r[("x", "y")] == r[("y", "x")] and all(v is None or -1 <= v <= 1 for v in r.values())


@FEW
@given(st.integers(1, 60), st.integers(1, 9))
def test_pages_make_up_the_table(spark, total, size):
    df = spark.range(total)
    pages = [[r[0] for r in rows.page(df, p + 1, size, "id", "DESC").collect()] for p in range(-(-total // size))]
    assert [x for p in pages for x in p] == list(range(total))[::-1]
