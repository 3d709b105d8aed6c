"""Ordered calculations over series against plain Python."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from longstats.operators.series import change_on_previous, moving_ratio, moving_sums, ranked, running_total, top_per_group

SCHEMA = "crop string, year int, fips string, n decimal(18,3), area decimal(18,3)"


def _rows(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        year = rng.choice((1990, 1991, 1993, 1994, 1995, 1999))  # gaps
        n_, a = (None if rng.random() < 0.2 else Decimal(rng.randint(-3, 9)) for _ in range(2))
        out.append((rng.choice(("corn", "rice", None)), year, rng.choice((None, "01", "02", "03", "10")), n_, a))
    return out + [("oats", 1990, "01", None, None), ("oats", 1991, "01", Decimal(0), Decimal(0)), ("oats", 1992, "01", Decimal(4), Decimal(2))]


def _sum(values):
    values = [v for v in values if v is not None]
    return sum(values, Decimal(0)) if values else None


def _points(rows, key, value=3):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r[value])
    return {k: _sum(v) for k, v in out.items()}


@pytest.mark.parametrize("back", [1, 2])
def test_change_keeps_gaps(spark, back):
    rows = _rows()
    points = _points(rows, lambda r: (r[0], r[1]))
    got = {(r["crop"], r["year"]): r for r in change_on_previous(spark.createDataFrame(rows, SCHEMA), ["crop"], "n", back=back).collect()}
    assert set(got) == set(points)
    for (crop, year), now in points.items():
        then = points.get((crop, year - back))
        change = None if now is None or then is None else now - then
        assert (got[crop, year]["n"], got[crop, year]["previous"], got[crop, year]["change"]) == (now, then, change)
        assert got[crop, year]["change_ratio"] == (float(change) / float(then) if change is not None and then else None)


def test_moving_figures(spark):
    rows = _rows(2)
    top, bottom = _points(rows, lambda r: (r[0], r[1])), _points(rows, lambda r: (r[0], r[1]), 4)
    df = spark.createDataFrame(rows, SCHEMA)
    sums = {(r["crop"], r["year"]): r for r in moving_sums(df, ["crop"], ["n", "area"], 3).collect()}
    whole = {(r["crop"], r["year"]): r["y"] for r in moving_ratio(df, ["crop"], "n", "area", "y", 3, complete=True).collect()}
    loose = {(r["crop"], r["year"]): r["y"] for r in moving_ratio(df, ["crop"], "n", "area", "y", 3).collect()}
    for crop, year in top:
        near = [(crop, y) for y in (year - 2, year - 1, year) if (crop, y) in top]
        a, b = _sum(top[k] for k in near), _sum(bottom[k] for k in near)
        assert (sums[crop, year]["n"], sums[crop, year]["area"], sums[crop, year]["periods"]) == (a, b, len(near))
        want = float(a) / float(b) if a is not None and b else None
        assert loose[crop, year] == want and whole[crop, year] == (want if len(near) == 3 else None)


@pytest.mark.parametrize("descending", [False, True])
def test_running_total_over_ranges(spark, descending):
    rows = _rows(3, 800)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    points = _points(rows, lambda r: (r[0], r[2]))
    got = {(r["crop"], r["fips"]): r["running_n"] for r in running_total(df, ["crop"], "fips", "n", descending).collect()}
    assert set(got) == set(points)
    for crop in {k[0] for k in points}:
        codes = sorted((k[1] for k in points if k[0] == crop and k[1]), reverse=descending) + [None] * ((crop, None) in points)
        for i, code in enumerate(codes):
            assert got[crop, code] == _sum(points[crop, c] for c in codes[:i + 1])


def test_a_hot_series_is_cut_into_ranges(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("crop"),
                                    F.col("id").alias("code"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_total(df, ["crop"], "code", "n")
        assert got.groupBy("crop").agg(F.max("running_n").alias("m"), F.count_distinct("running_n").alias("c")).orderBy("crop").collect() == [
            ("cold", 2000, 2000), ("hot", 18000, 18000)]
        assert got.filter("crop = 'hot' and running_n <> code + 1 - code div 10").count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        # the rows' window is by series and range; none goes without keys
        assert any("_range" in x.split("],")[1] for x in windows) and "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(spark, descending):
    rows = _rows(4)
    got = ranked(spark.createDataFrame(rows, SCHEMA), ["crop"], "n", descending=descending)
    assert got.columns == ["crop", "year", "fips", "n", "area", "place", "place_dense"] and got.count() == len(rows)
    for r in got.collect():
        group = [x[3] for x in rows if x[0] == r["crop"]]
        better = [v for v in group if v is not None and (r["n"] is None or (v > r["n"] if descending else v < r["n"]))]
        assert r["place"] == len(better) + 1 and r["place_dense"] == len(set(better)) + 1


def test_a_value_that_a_third_of_all_rows_share(spark):
    rows = [("corn", 1, str(i), Decimal(5 if i % 3 else i), None) for i in range(900)]
    got = ranked(spark.createDataFrame(rows, SCHEMA), ["crop"], "n")
    assert got.filter("n = 5").select("place").distinct().collect() == [(299,)]


def test_top_rows_with_and_without_ties(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, SCHEMA).filter("n is not null")
    got = defaultdict(list)
    for r in top_per_group(df, ["crop", "year"], [F.col("n").desc()], 2).collect():
        got[r["crop"], r["year"]].append((r["n"], r["place"]))
    groups = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            groups[r[0], r[1]].append(r[3])
    for k, values in groups.items():
        assert sorted(got[k]) == sorted((v, 1 + sum(o > v for o in values)) for v in values if sum(o > v for o in values) < 2)
    total = [F.col(c).desc() for c in ("n", "fips", "area")]
    alone = top_per_group(df, ["crop", "year"], total, 2, ties=False)
    assert all(r["count"] <= 2 for r in alone.groupBy("crop", "year").count().collect())
    for frame in (alone, top_per_group(df, ["crop"], [F.col("n").desc()], 3)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "WindowGroupLimit" in x or "Exchange" in x]
        # from the top: final limit, exchange, limit in every task
        assert "Final" in lines[0] and "Exchange" in lines[1] and "Partial" in lines[2], lines


def test_empty_tables(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).limit(0)
    for got in (change_on_previous(df, ["crop"], "n"), moving_sums(df, ["crop"], ["n"], 3), running_total(df, ["crop"], "fips", "n"),
                ranked(df, ["crop"], "n"), top_per_group(df, ["crop"], [F.col("n")], 3)):
        assert got.count() == 0
