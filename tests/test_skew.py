"""Hot keys: one key holding a third of the rows must not land in a single task,
and results stay whole and exact."""

from pyspark.sql import functions as F

from conftest import long_rows
from longstats.operators import rollup_level, with_partition_total
from longstats.session import scratch_path
from longstats.sources import write_table


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        hot = i % 3 == 0          # a third of all rows share one (year, level, state, commodity)
        rows.append({"year": 2000 if hot else 1990 + i % 20, "state_name": "IOWA" if hot else f"S{i % 40}",
                     "commodity_desc": "CORN" if hot else "SOYBEANS", "county_code": f"{i % 7:03d}",
                     "county_name": f"C{i % 7}", "statisticcat_desc": "AREA HARVESTED", "value": str(i)})
    return long_rows(spark, rows)


def test_write_table_spreads_a_hot_group_over_tasks(spark):
    df = _skewed(spark).repartition(16)
    path = scratch_path(spark, "skew-layout")
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        write_table(df, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    hot = back.filter((F.col("year") == 2000) & (F.col("state_name") == "IOWA"))
    files = hot.select(F.input_file_name().alias("f")).distinct().count()
    assert hot.count() == 1000 and files > 1


def test_rollup_with_hot_group_is_exact(spark):
    df = _skewed(spark)
    out = rollup_level(df, "COUNTY").filter((F.col("year") == 2000) & (F.col("state_name") == "IOWA"))
    expected = {}
    for i in range(0, 3000, 3):
        expected[i % 7] = expected.get(i % 7, 0) + i
    got = {int(r.fips_county_code[-3:]): int(r.area_harvested) for r in out.collect()}
    assert got == expected


def test_partition_total_with_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 100).cast("string")).alias("k"),
        F.col("id").alias("v"))
    out = with_partition_total(df, ["k"], "v", "total")
    hot_total = sum(i for i in range(30000) if i % 3 == 0)
    assert out.count() == 30000
    assert {r.total for r in out.filter("k = 'hot'").select("total").distinct().collect()} == {hot_total}
