"""Grouping sets in one pass equal the single roll-ups."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from longstats.operators.totals import at_level, cube_sets, level_totals, rollup_sets

SCHEMA = "crop string, state string, county string, n decimal(18,3), y double"
ROWS = [("corn", "a", "x", Decimal(1), 1.5), ("corn", "a", "x", Decimal(2), None), ("corn", "a", None, Decimal(5), 2.5), ("corn", None, None, None, None),
        ("rice", "b", "y", Decimal(7), 4.0), ("rice", "b", "y", Decimal(7), 4.0), (None, None, None, Decimal(9), 0.5), ("rice", None, "z", Decimal(-7), 8.0)]


def _told(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("levels", [rollup_sets(["crop", "state", "county"]), cube_sets(["crop", "state", "county"]),
                                    {"state": ["state"], "crop": ["crop"]}, {"all": []}])
def test_equals_the_single_roll_ups(spark, levels):
    df = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(3)
    got = level_totals(df, levels, sums=["n"], averages=["y"], least=["y"], greatest=["n"])
    for level, keys in levels.items():
        single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.sum("n").alias("n"), F.avg("y").alias("average_y"),
                                       F.min("y").alias("least_y"), F.max("n").alias("greatest_n"))
        one = at_level(got, levels, level)
        assert one.columns == single.columns
        assert _told(one) == _told(single), level
    assert got.filter(F.col("level").isNull()).count() == 0


def test_null_as_a_value_and_as_a_total(spark):
    got = level_totals(spark.createDataFrame(ROWS, SCHEMA), rollup_sets(["crop", "state"]), sums=["n"])
    nulls = {(r["level"], r["level_id"], r["crop"]): r["row_count"] for r in got.collect() if r["state"] is None}
    assert nulls == {("state", 0, "corn"): 1, ("state", 0, None): 1, ("state", 0, "rice"): 1,
                     ("crop", 1, "corn"): 4, ("crop", 1, "rice"): 3, ("crop", 1, None): 1, ("all", 3, None): 8}


def test_the_table_is_not_repeated(spark):
    """Expand stands above the finest sums, so it repeats groups and not rows."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = level_totals(df, cube_sets(["crop", "state", "county"]), sums=["n"])._jdf.queryExecution().executedPlan().toString()
    tree = plan.splitlines()
    expand = next(i for i, x in enumerate(tree) if "Expand" in x)
    assert any("HashAggregate" in x for x in tree[expand + 1:]) and sum("Expand" in x for x in tree) == 1


def test_empty_table_and_faults(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert level_totals(df.limit(0), rollup_sets(["crop", "state"]), sums=["n"]).count() == 0
    assert level_totals(df.limit(0), {"all": []}, sums=["n"]).count() == 0
    for levels in ({}, {"a": ["crop"], "b": ["crop"]}, {"a": ["n"]}):
        with pytest.raises(ValueError):
            level_totals(df, levels, sums=["n"])
