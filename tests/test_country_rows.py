"""country_rows lists all rows of its countries: every year and level, as the reference's statement does."""

from pyspark.sql import functions as F

from longstats.plans.queries import HOME_COUNTRY, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_years_and_levels_of_the_countries(spark):
    got = QUERIES["country_rows"](spark, SF)
    region = spark.read.parquet(f"{SF}/region.parquet").where(F.col("r_name") != HOME_COUNTRY)
    abroad = [r[0] for r in spark.read.parquet(f"{SF}/nation.parquet")
              .join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name").collect()]
    want = QUERIES["load_table"](spark, SF).where(F.col("state_name").isin(abroad))
    keys = ["state_name", "year", "agg_level_desc"]

    def per_key(df):
        return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}

    assert per_key(got) == per_key(want)
    assert got.select("year").distinct().count() > 1 and got.select("agg_level_desc").distinct().count() > 1
