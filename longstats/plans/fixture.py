"""Long statistics view derived from the driver's TPC-H-like tables.

One row per lineitem row, 19 raw columns, mapped onto the statistics domain by
fixed modulo rules (crop from part, statistic from line number, level from
order key, state from the customer's nation, county from the customer).  The
same view exists as DuckDB SQL (``LONG_VIEW_DUCKDB``) for the oracles; both
give identical rows.

At scale this is orders joined to customers (sort-merge on the customer key,
or broadcast when AQE measures customers small) and nation (25 rows, under
the static size threshold, so broadcast), then lineitem joined once to that
orders-sized result on the order key: lineitem is shuffled a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longstats.schemas import LONG_COLUMNS

#: Rows of lineitem in a task of the landing, which sorts them in memory at their full width (some 450 bytes each).
ROWS_PER_TASK = 500_000


def _case(col: Column, mapping: list[tuple[object, str]], default: str) -> Column:
    expr = None
    for key, value in mapping:
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr.otherwise(default)


def long_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived long statistics table over ``sf_dir``'s parquet tables."""
    # Hash-partition lineitem on the order key: the partitioning the sort-merge
    # join with orders needs anyway at scale (no extra exchange is planned), and
    # it spreads the per-row mapping when a file has few row groups.  The number
    # of partitions follows the rows (counted from the files' footers), not the
    # shuffled bytes: a row is some twenty times wider once it is mapped.
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lineitem.count()
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    if rows > ROWS_PER_TASK * spark.sparkContext.defaultParallelism:
        li = li.repartition(-(-rows // ROWS_PER_TASK), "l_orderkey")
    else:
        li = li.repartition("l_orderkey")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    na = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    # Orders are enriched with their customer's nation first (orders-sized), then
    # joined to lineitem once on the order key: one lineitem-sized shuffle, on
    # the key lineitem is already partitioned by.
    order_place = (od.join(cu, od.o_custkey == cu.c_custkey)
                   .join(na, cu.c_nationkey == na.n_nationkey)
                   .select("o_orderkey", "c_custkey", "n_nationkey", "n_name"))
    # No hint: small orders are broadcast by their checked size, large ones meet
    # lineitem in a sort-merge join, which spills and splits skewed partitions.
    j = li.join(order_place, li.l_orderkey == order_place.o_orderkey)

    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    crop_no = pk % 8
    base = j.select(
        F.when(sk % 11 == 0, "CENSUS").otherwise("SURVEY").alias("source_desc"),
        _case(crop_no, [(0, "CORN"), (1, "SOYBEANS"), (2, "WHEAT"), (3, "COTTON"), (4, "RICE"),
                        (5, "SWEET CORN"), (6, "POPCORN")], "BARLEY").alias("commodity_desc"),
        F.when(crop_no.isin(2, 3), _case(sk % 3, [(0, "ALL CLASSES"), (1, "SPRING, (EXCL DURUM)")], "WINTER"))
         .otherwise("ALL CLASSES").alias("class_desc"),
        F.when(crop_no == 0, _case(ok % 3, [(0, "GRAIN"), (1, "SILAGE")], "ALL UTILIZATION PRACTICES"))
         .otherwise("ALL UTILIZATION PRACTICES").alias("util_practice_desc"),
        F.when(ok % 13 == 0, "IRRIGATED").otherwise("ALL PRODUCTION PRACTICES").alias("prodn_practice_desc"),
        _case(F.col("l_linenumber"), [(1, "AREA PLANTED"), (2, "AREA HARVESTED"), (3, "YIELD"),
                                      (4, "PRODUCTION"), (5, "PRODUCTION"), (6, "AREA HARVESTED")],
              "PRICE RECEIVED").alias("statisticcat_desc"),
        F.when(ok % 17 == 0, "YEAR - AUG FORECAST").otherwise("YEAR").alias("reference_period_desc"),
        F.when(ok % 5 == 0, "STATE").when(ok % 23 == 1, "NATIONAL").when(ok % 31 == 2, "WATERSHED")
         .otherwise("COUNTY").alias("agg_level_desc"),
        (sk % 19).alias("noise"), F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nname"),
        F.col("c_custkey").alias("ck"), F.year("l_shipdate").cast("int").alias("yr"),
        F.when(ok % 29 == 0, "(D)").when(ok % 37 == 0, F.lit(None).cast("string"))
         .otherwise(F.format_number("l_extendedprice", 2)).alias("value_text"),
    )

    stat, crop, util, level = (F.col("statisticcat_desc"), F.col("commodity_desc"),
                               F.col("util_practice_desc"), F.col("agg_level_desc"))
    is_yield = stat == "YIELD"
    unit_stem = (F.when(crop == "COTTON", F.when(is_yield, "LB").otherwise("480 LB BALES"))
                  .when(crop == "RICE", F.when(is_yield, "LB").otherwise("CWT"))
                  .when((crop == "CORN") & (util == "SILAGE"), "TONS").otherwise("BU"))
    unit = (F.when(F.col("noise") == 0, "$")
             .when(stat.isin("AREA PLANTED", "AREA HARVESTED"), "ACRES")
             .when(stat == "PRICE RECEIVED", "$ / BU")
             .otherwise(F.concat(unit_stem, F.when(is_yield, " / ACRE").otherwise(""))))
    ck5 = F.col("ck") % 5
    out = base.select(
        "source_desc", "commodity_desc", "class_desc", "prodn_practice_desc", "util_practice_desc",
        "statisticcat_desc", unit.alias("unit_desc"),
        F.concat(crop, F.lit(", "), util, F.lit(" - "), stat).alias("short_desc"),
        F.lit("TOTAL").alias("domain_desc"), "agg_level_desc",
        F.when(level == "NATIONAL", "99").otherwise(F.lpad((F.col("nk") + 1).cast("string"), 2, "0"))
         .alias("state_fips_code"),
        F.when(level == "NATIONAL", "US").when(level == "WATERSHED", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("N"), F.col("nk").cast("string"))).alias("state_alpha"),
        F.when(level == "NATIONAL", "US TOTAL").when(level == "WATERSHED", F.lit(None).cast("string"))
         .otherwise(F.col("nname")).alias("state_name"),
        F.when(level == "COUNTY", F.lpad(ck5.cast("string"), 3, "0")).alias("county_code"),
        F.when(level == "COUNTY", F.when(ck5 == 4, "OTHER (COMBINED) COUNTIES")
               .otherwise(F.concat(F.lit("COUNTY-"), ck5.cast("string")))).alias("county_name"),
        F.col("yr").alias("year"), F.lit("ANNUAL").alias("freq_desc"), "reference_period_desc",
        F.col("value_text").alias("value"),
    )
    return out.select(*LONG_COLUMNS)


# The same view for DuckDB (oracle side).  Text kept in the form checked to give
# identical rows to the Spark view above.
LONG_VIEW_DUCKDB = """
SELECT source_desc, commodity_desc, class_desc, prodn_practice_desc, util_practice_desc, statisticcat_desc,
  CASE WHEN noise = 0 THEN '$'
       WHEN statisticcat_desc IN ('AREA PLANTED','AREA HARVESTED') THEN 'ACRES'
       WHEN statisticcat_desc = 'PRICE RECEIVED' THEN '$ / BU'
       ELSE (CASE WHEN commodity_desc = 'COTTON' THEN CASE WHEN statisticcat_desc = 'YIELD' THEN 'LB' ELSE '480 LB BALES' END
                  WHEN commodity_desc = 'RICE' THEN CASE WHEN statisticcat_desc = 'YIELD' THEN 'LB' ELSE 'CWT' END
                  WHEN commodity_desc = 'CORN' AND util_practice_desc = 'SILAGE' THEN 'TONS' ELSE 'BU' END)
            || CASE WHEN statisticcat_desc = 'YIELD' THEN ' / ACRE' ELSE '' END END AS unit_desc,
  commodity_desc || ', ' || util_practice_desc || ' - ' || statisticcat_desc AS short_desc,
  'TOTAL' AS domain_desc, agg_level_desc,
  CASE agg_level_desc WHEN 'NATIONAL' THEN '99' ELSE lpad(cast(nk + 1 AS varchar), 2, '0') END AS state_fips_code,
  CASE agg_level_desc WHEN 'NATIONAL' THEN 'US' WHEN 'WATERSHED' THEN NULL ELSE 'N' || cast(nk AS varchar) END AS state_alpha,
  CASE agg_level_desc WHEN 'NATIONAL' THEN 'US TOTAL' WHEN 'WATERSHED' THEN NULL ELSE nname END AS state_name,
  CASE WHEN agg_level_desc = 'COUNTY' THEN lpad(cast(ck % 5 AS varchar), 3, '0') END AS county_code,
  CASE WHEN agg_level_desc = 'COUNTY' THEN CASE WHEN ck % 5 = 4 THEN 'OTHER (COMBINED) COUNTIES' ELSE 'COUNTY-' || cast(ck % 5 AS varchar) END END AS county_name,
  yr AS year, 'ANNUAL' AS freq_desc, reference_period_desc, value_text AS value
FROM (SELECT
  CASE WHEN l_suppkey % 11 = 0 THEN 'CENSUS' ELSE 'SURVEY' END AS source_desc,
  CASE l_partkey % 8 WHEN 0 THEN 'CORN' WHEN 1 THEN 'SOYBEANS' WHEN 2 THEN 'WHEAT' WHEN 3 THEN 'COTTON' WHEN 4 THEN 'RICE' WHEN 5 THEN 'SWEET CORN' WHEN 6 THEN 'POPCORN' ELSE 'BARLEY' END AS commodity_desc,
  CASE WHEN l_partkey % 8 IN (2,3) THEN CASE l_suppkey % 3 WHEN 0 THEN 'ALL CLASSES' WHEN 1 THEN 'SPRING, (EXCL DURUM)' ELSE 'WINTER' END ELSE 'ALL CLASSES' END AS class_desc,
  CASE WHEN l_partkey % 8 = 0 THEN CASE l_orderkey % 3 WHEN 0 THEN 'GRAIN' WHEN 1 THEN 'SILAGE' ELSE 'ALL UTILIZATION PRACTICES' END ELSE 'ALL UTILIZATION PRACTICES' END AS util_practice_desc,
  CASE WHEN l_orderkey % 13 = 0 THEN 'IRRIGATED' ELSE 'ALL PRODUCTION PRACTICES' END AS prodn_practice_desc,
  CASE l_linenumber WHEN 1 THEN 'AREA PLANTED' WHEN 2 THEN 'AREA HARVESTED' WHEN 3 THEN 'YIELD' WHEN 4 THEN 'PRODUCTION' WHEN 5 THEN 'PRODUCTION' WHEN 6 THEN 'AREA HARVESTED' ELSE 'PRICE RECEIVED' END AS statisticcat_desc,
  CASE WHEN l_orderkey % 17 = 0 THEN 'YEAR - AUG FORECAST' ELSE 'YEAR' END AS reference_period_desc,
  CASE WHEN l_orderkey % 5 = 0 THEN 'STATE' WHEN l_orderkey % 23 = 1 THEN 'NATIONAL' WHEN l_orderkey % 31 = 2 THEN 'WATERSHED' ELSE 'COUNTY' END AS agg_level_desc,
  l_suppkey % 19 AS noise, n_nationkey AS nk, n_name AS nname, c_custkey AS ck, cast(year(l_shipdate) AS int) AS yr,
  CASE WHEN l_orderkey % 29 = 0 THEN '(D)' WHEN l_orderkey % 37 = 0 THEN NULL ELSE format('{:,.2f}', l_extendedprice) END AS value_text
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) b
"""
