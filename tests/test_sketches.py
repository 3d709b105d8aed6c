"""Stored sketches: within their error, and merged ones as good as those of all rows together."""

from pyspark.sql import functions as F

from longstats.operators.sketches import column_sketches, merge_sketches, sketch_report
from longstats.session import materialize


def _data(spark, n=60_000):
    return spark.range(n).select((F.col("id") % 3).cast("int").alias("year"), (F.col("id") * 7919 % 20_011).alias("code"),
                                 F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") * 31 % 1000).cast("string")).alias("value"),
                                 F.when(F.col("id") % 2 == 0, "x").alias("word"))


def test_estimates_are_within_their_error(spark):
    df = _data(spark)
    got = {r["column_name"]: r for r in sketch_report(column_sketches(df, ["code", "value", "word"])).collect()}
    assert abs(got["code"]["distinct_estimate"] / 20_011 - 1) < 0.05 and abs(got["value"]["distinct_estimate"] / 900 - 1) < 0.05
    assert got["word"]["distinct_estimate"] == 1 and got["word"]["quantiles"] is None
    assert (got["value"]["row_count"], got["value"]["null_count"], got["word"]["null_count"]) == (60_000, 6_000, 30_000)
    for q, x in zip((0.25, 0.5, 0.75), got["value"]["quantiles"]):
        rank = df.filter("value is not null").agg(F.avg((F.col("value").cast("double") <= x).cast("int"))).first()[0]
        assert abs(rank - q) < 0.03


def test_merged_loads_equal_one_load(spark):
    df = _data(spark)
    stored = materialize(column_sketches(df.filter("year < 2"), ["code", "value"], by=["year"]), "profiles")
    later = column_sketches(df.filter("year = 2"), ["code", "value"], by=["year"])
    merged = {r["column_name"]: r for r in sketch_report(merge_sketches(stored.unionByName(later))).collect()}
    whole = {r["column_name"]: r for r in sketch_report(column_sketches(df, ["code", "value"])).collect()}
    for name, one in whole.items():
        for c in ("row_count", "null_count", "least", "greatest"):
            assert merged[name][c] == one[c]
        # a union of sketches estimates by registers alone, one sketch also by its history: both within the error
        assert abs(merged[name]["distinct_estimate"] / one["distinct_estimate"] - 1) < 0.05
    per_year = merge_sketches(stored.unionByName(later), by=["year"])
    assert per_year.count() == 6


def test_empty_and_all_null(spark):
    df = _data(spark, 100)
    assert column_sketches(df.limit(0), ["code"]).count() == 0
    got = sketch_report(column_sketches(df.withColumn("none", F.lit(None).cast("string")), ["none"])).first()
    assert (got["row_count"], got["null_count"], got["distinct_estimate"], got["quantiles"]) == (100, 100, 0, None)
