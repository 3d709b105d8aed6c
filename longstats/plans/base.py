"""What the registered queries share: the landed long table, its core scope, the cleaned job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from longstats.functions.text import county_id
from longstats.operators.scope import core_scope
from longstats.plans import catalog
from longstats.plans import oracle_sql as o
from longstats.schemas import DIMENSION_SCHEMA

MIN_YEAR = o.MIN_YEAR

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as double and dates as ISO text, for engine-neutral comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.long_table(spark, sf)


def _core(spark: SparkSession, sf: str) -> DataFrame:
    return core_scope(_long(spark, sf), min_year=MIN_YEAR)


def _job(spark: SparkSession, sf: str) -> catalog.CleanJob:
    return catalog.clean_job(spark, sf, MIN_YEAR)


def county_dimension(long: DataFrame) -> DataFrame:
    """A 45-column county dimension derived from the county rows: keys, row count,
    distinct years, and 40 measures computed from those two."""
    counties = (long.filter(F.col("agg_level_desc") == "COUNTY")
                .groupBy(county_id().alias("fipstxt"), F.col("state_alpha").alias("state"),
                         F.col("county_name").alias("county"))
                .agg(F.count(F.lit(1)).cast("double").alias("n"),
                     F.count_distinct("year").cast("double").alias("y")))
    names = [f.name for f in DIMENSION_SCHEMA.fields]
    measures = [F.col("n"), F.col("y")] + [F.col("n") * k + F.col("y") for k in range(2, len(names) - 3)]
    return counties.select("fipstxt", "state", "county", *[m.alias(n) for m, n in zip(measures, names[3:])])
