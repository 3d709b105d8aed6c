"""As-of, dimension and band joins against plain Python."""

import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from longstats.operators.asof import asof_join
from longstats.operators.bands import band_join
from longstats.operators.dimension import dimension_versions, edition_stems, fips_text, join_dimension, match_summary
from longstats.schemas import DIMENSION_COLUMNS


def _told(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# ---------------------------------------------------------------- as-of

def _asof_case(seed, rows=500, entries=60):
    rng = random.Random(seed)
    left = [(rng.choice((None, "hot", "hot", "hot", "a", "b", "z")), rng.choice((None, *range(1990, 2020))), i) for i in range(rows)]
    right = [(rng.choice((None, "hot", "a", "b", "c")), rng.choice((None, *range(1995, 2025))), rng.choice((None, 1, 2, 3)), rng.choice(("x", None)))
             for _ in range(entries)]
    return left, right


def _asof(left, right, tolerance=None):
    best = {}
    for k, t, code, name in right:
        if k is not None and t is not None:
            order = (code is not None, code or 0, name is not None, name or "")
            if (k, t) not in best or order > best[k, t][0]:
                best[k, t] = (order, (t, code, name))
    out = []
    for k, t, i in left:
        times = [s for (key, s) in best if key == k and t is not None and s <= t]
        hit = best[k, max(times)][1] if times and k is not None else (None, None, None)
        if tolerance is not None and hit[0] is not None and t - hit[0] > tolerance:
            hit = (None, None, None)
        out.append((k, t, i, *hit))
    return sorted(map(str, out))


@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_join(spark, tolerance):
    left, right = _asof_case(1)
    got = asof_join(spark.createDataFrame(left, "k string, year int, i int").repartition(4),
                    spark.createDataFrame(right, "k string, since int, code int, name string"), ["k"], "year", "since", ["code", "name"], tolerance)
    assert got.columns == ["k", "year", "i", "since", "code", "name"]
    assert _told(got) == _asof(left, right, tolerance)


def test_asof_join_carries_over_range_edges_without_a_cross_join(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left, right = [("hot", y, i) for i, y in enumerate(list(range(1900, 2100)) * 20)], [("hot", 1905, 7, "x"), ("hot", 2050, 8, "y")]
        got = asof_join(spark.createDataFrame(left, "k string, year int, i int"),
                        spark.createDataFrame(right, "k string, since int, code int, name string"), ["k"], "year", "since", ["code", "name"])
        assert _told(got) == _asof(left, right)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_join_of_empty_tables_and_clashes(spark):
    left, right = _asof_case(2, 20, 5)
    rows, entries = spark.createDataFrame(left, "k string, year int, i int"), spark.createDataFrame(right, "k string, since int, code int, name string")
    assert asof_join(rows.limit(0), entries, ["k"], "year", "since", ["code"]).count() == 0
    assert _told(asof_join(rows, entries.limit(0), ["k"], "year", "since", ["code", "name"])) == _asof(left, [])
    with pytest.raises(ValueError, match="columns of the rows"):
        asof_join(rows, entries.withColumnRenamed("code", "i"), ["k"], "year", "since", ["i"])


# ---------------------------------------------------------------- dimension

def _dimension(spark):
    return spark.createDataFrame([("01001", 1.0, 2.0), ("01003", None, 4.0), (None, 9.0, 9.0), ("56045", None, None)], "fipstxt string, metro2003 double, metro2013 double")


def test_fips_text(spark):
    codes = ["1001", "01001", " 56045 ", "123", "123456", "0100A", "", None]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(fips_text("c").alias("f")).collect()
    assert [r.f for r in got] == ["01001", "01001", "56045", None, None, None, None, None]


def test_rows_are_kept_once_and_told_apart(spark):
    rows = spark.createDataFrame([("01001", 1), ("01001", 2), ("99999", 3), (None, 4), (None, 5), ("01003", 6)], "fips string, n int")
    got = join_dimension(rows, _dimension(spark), "fips", "fipstxt", ["metro2013"])
    assert _told(got) == sorted(map(str, [("01001", 1, 2.0, "matched"), ("01001", 2, 2.0, "matched"), ("99999", 3, None, "unmatched"),
                                          (None, 4, None, "null_key"), (None, 5, None, "null_key"), ("01003", 6, 4.0, "matched")]))
    told = match_summary(rows, _dimension(spark), "fips", "fipstxt")
    assert _told(told) == sorted(map(str, [("matched", 3, 2), ("unmatched", 1, 1), ("null_key", 2, 0)]))
    assert join_dimension(rows.limit(0), _dimension(spark), "fips", "fipstxt", ["metro2013"]).count() == 0
    with pytest.raises(ValueError, match="01001"):
        join_dimension(rows, _dimension(spark).union(_dimension(spark).filter("fipstxt = '01001'")), "fips", "fipstxt", ["metro2013"])


def test_rows_without_a_key_are_not_shuffled(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 100 == 0, "01001").alias("fips"), F.col("id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_dimension(rows, _dimension(spark), "fips", "fipstxt", ["metro2013"])
        assert got.groupBy("match").count().orderBy("match").collect() == [("matched", 100), ("null_key", 9900)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        lines = plan.splitlines()
        at = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(fips" in x)
        assert "isnotnull" in "".join(lines[at:at + 4]) or "isnotnull" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_versions_of_a_wide_dimension(spark):
    got = dimension_versions(_dimension(spark), "fipstxt", {"metro": "METRO"}, [2003, 2013])
    assert _told(got) == sorted(map(str, [("01001", 2003, 1.0), ("01001", 2013, 2.0), ("01003", 2013, 4.0), (None, 2003, 9.0), (None, 2013, 9.0)]))
    assert "ruralurbancontinuumcode" in edition_stems([c.lower() for c in DIMENSION_COLUMNS], [2003, 2013])
    with pytest.raises(ValueError, match="1999"):
        dimension_versions(_dimension(spark), "fipstxt", {"metro": "metro"}, [1999])


# ---------------------------------------------------------------- bands

def _bands_case(seed):
    rng = random.Random(seed)
    bands = []
    for i in range(80):
        low = Decimal(rng.randint(-10**6, 10**6)) / 1000
        width = Decimal(rng.choice((1, 5, 1000, 64_000, 10**7, 10**9))) / 1000
        bands.append((i, None if i % 19 == 0 else low, None if i % 23 == 0 else low + width))
    bands += [(100, Decimal(5), Decimal(5)), (101, Decimal(6), Decimal(5)), (102, None, None), (103, Decimal(0), Decimal(1024))]
    edges = [b for r in bands for b in r[1:] if b is not None]
    values = [rng.choice((None, rng.choice(edges), Decimal(rng.randint(-2 * 10**6, 2 * 10**6)) / 1000)) for _ in range(400)]
    return list(enumerate(values)), bands


@pytest.mark.parametrize("how", ["inner", "left"])
def test_bands_of_very_different_widths(spark, how):
    rows, bands = _bands_case(3)
    got = band_join(spark.createDataFrame(rows, "i int, v decimal(20,3)").repartition(4),
                    spark.createDataFrame(bands, "band int, low decimal(20,3), high decimal(20,3)"), "v", "low", "high", how)
    want = []
    for i, v in rows:
        hits = [b for b, low, high in bands if v is not None and (low is None or low <= v) and (high is None or v < high)]
        want += [(i, b) for b in hits] or ([(i, None)] if how == "left" else [])
    assert Counter((r["i"], r["band"]) for r in got.collect()) == Counter(want)


def test_bands_cost_two_rows_each_and_no_cross_join(spark):
    rows, bands = _bands_case(4)
    got = band_join(spark.createDataFrame(rows, "i int, v decimal(20,3)"), spark.createDataFrame(bands, "band int, low decimal(20,3), high decimal(20,3)"), "v", "low", "high")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got.count()


def test_doubles_at_the_ends(spark):
    values = [float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, 1.7e308, None, 0.1 + 0.2]
    bands = [(1, None, None), (2, 0.0, 5e-324), (3, 0.3, 0.30000000000000005), (4, 1e308, None), (5, None, -1.0)]
    got = defaultdict(set)
    for r in band_join(spark.createDataFrame(list(enumerate(values)), "i int, v double"),
                       spark.createDataFrame(bands, "band int, low double, high double"), "v", "low", "high").collect():
        got[r["i"]].add(r["band"])
    want = {i: {b for b, lo, hi in bands if (lo is None or lo <= v) and (hi is None or v < hi)}
            for i, v in enumerate(values) if v is not None and not math.isnan(v)}
    assert {i: s for i, s in got.items()} == {i: s for i, s in want.items() if s}


def test_no_band_and_no_row(spark):
    rows, bands = _bands_case(5)
    r, b = spark.createDataFrame(rows, "i int, v decimal(20,3)"), spark.createDataFrame(bands, "band int, low decimal(20,3), high decimal(20,3)")
    assert band_join(r.limit(0), b, "v", "low", "high").count() == 0
    assert band_join(r, b.limit(0), "v", "low", "high").count() == 0
    assert band_join(r, b.limit(0), "v", "low", "high", "left").count() == len(rows)


@pytest.mark.parametrize("kind", ["decimal(20,3)", "double"])
def test_totals_per_band_equal_those_of_the_pairs(spark, kind):
    rows, bands = _bands_case(6)
    rows = spark.createDataFrame([(("a", "b", None)[i % 3], v) for i, v in rows], "g string, v decimal(20,3)").selectExpr("g", f"CAST(v AS {kind}) AS v")
    if kind == "double":
        rows = rows.unionByName(spark.createDataFrame([("a", float("nan")), ("b", float("inf")), (None, -float("inf"))], "g string, v double"))
    bands = spark.createDataFrame([*bands, bands[3]], "band int, low decimal(20,3), high decimal(20,3)")
    pairs = (band_join(rows, bands, "v", "low", "high").groupBy("band", "g")
             .agg(F.count(F.lit(1)).alias("row_count"), F.min("v").alias("least"), F.max("v").alias("greatest")))
    totals = (band_join(rows, bands, "v", "low", "high", by=["g"]).groupBy("band", "g")
              .agg(F.sum("row_count").alias("row_count"), F.min("least").alias("least"), F.max("greatest").alias("greatest")))
    assert _told(totals) == _told(pairs)
    assert band_join(rows, bands.limit(0), "v", "low", "high", by=["g"]).count() == 0
    assert band_join(rows.limit(0), bands, "v", "low", "high", by=["g"]).count() == 0


def test_totals_make_no_pairs(spark):
    """Before: 400 rows in each of 300 bands were 120,000 pairs."""
    rows = spark.range(400).selectExpr("'a' AS g", "CAST(id AS double) AS v")
    bands = spark.range(300).selectExpr("id AS band", "CAST(-1 AS double) AS low", "CAST(1000 + id AS double) AS high")
    got = band_join(rows, bands, "v", "low", "high", by=["g"])
    assert {tuple(r)[3:] for r in got.collect()} == {("a", 400, 0.0, 399.0)} and got.count() == 300
    assert "_bin" not in got._jdf.queryExecution().optimizedPlan().toString()
