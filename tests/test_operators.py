"""Edge cases of the smaller operators: NULL keys, empty input, type alignment."""

from pyspark.sql import functions as F

from longstats.operators import (
    check_load,
    coverage_profile,
    numeric_format_profile,
    reconcile_levels,
    row_count,
    union_aligned,
    variety_from_label,
    with_grand_total,
)


def test_reconcile_matches_null_keys_and_one_sided_groups(spark):
    a = spark.createDataFrame([(1, None, 10.0), (1, None, 5.0), (2, "x", 1.0)], "y int, k string, m double")
    b = spark.createDataFrame([(1, None, 12.0), (3, "z", 7.0)], "y int, k string, m double")
    out = {(r.y, r.k): r for r in reconcile_levels(a, b, ["y", "k"], ["m"]).collect()}
    assert (out[(1, None)].m_a, out[(1, None)].m_b, out[(1, None)].m_diff) == (15.0, 12.0, 3.0)
    assert (out[(2, "x")].m_a, out[(2, "x")].m_b) == (1.0, None)
    assert (out[(3, "z")].m_a, out[(3, "z")].m_b) == (None, 7.0)


def test_union_aligned_fills_typed_nulls(spark):
    a = spark.createDataFrame([(1, "a")], "x int, s string")
    b = spark.createDataFrame([(2.5,)], "d double")
    out = union_aligned(a, b)
    assert out.columns == ["x", "s", "d"]
    assert dict(out.dtypes) == {"x": "int", "s": "string", "d": "double"}
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a", None), (None, None, 2.5)]


def test_grand_total_beside_each_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    assert {r.k: r.t for r in with_grand_total(df, "v", "t").collect()} == {"a": 3, "b": 3, "c": 3}


def test_counts_on_empty_input(spark):
    empty = spark.createDataFrame([], "x int")
    r = row_count(empty).first()
    assert (r.row_count, r.row_sum) == (0, None)          # COUNT(*) is 0, SUM(1) is NULL
    c = check_load(empty, 0).first()
    assert (c.row_count, c.expected_rows, c.rows_match, c.probe_rows) == (0, 0, True, 0)


def test_coverage_profile_skips_nulls_and_orders(spark):
    df = spark.createDataFrame([("S", 2001, "B"), ("S", 1999, "A"), ("S", 2001, "A"), ("S", 2001, "A"),
                                ("S", None, "C"), ("T", 2000, None)],
                               "state_name string, year int, commodity_desc string")
    rows = {r.state_name: r for r in coverage_profile(df).collect()}
    s = rows["S"]
    assert s.production_years == [1999, 2001]
    assert s.commodities_produced == ["A", "B", "C"]
    assert s.commodities_produced_year == ["1999-A", "2001-A", "2001-B"]   # NULL labels dropped
    assert s.unique_commodities == 3
    assert rows["T"].commodities_produced == [] and rows["T"].unique_commodities == 0


def test_numeric_format_profile(spark):
    df = spark.createDataFrame([("1,234,567.5",), ("12.345",), ("(D)",), (None,)], "value string")
    r = numeric_format_profile(df).first()
    assert (r.max_place_value, r.max_decimal_places) == (2, 3)


def test_variety_from_label(spark):
    df = spark.createDataFrame([("WHEAT, SPRING, (EXCL DURUM) - ACRES HARVESTED",), ("CORN, GRAIN - YIELD",),
                                ("RICE - PRODUCTION",), (None,)], "short_desc string")
    out = [tuple(r) for r in df.select(*[c.alias(n) for n, c in variety_from_label().items()]).collect()]
    assert out == [("WHEAT, SPRING, (EXCL DURUM)", " (EXCL DURUM)"), ("CORN, GRAIN", " GRAIN"),
                   ("RICE", None), (None, None)]
