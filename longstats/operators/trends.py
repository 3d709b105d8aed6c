"""Yearly trend of one crop: harvested, planted, production and yield."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longstats.functions.numbers import safe_ratio

# Fixed value: bushels per short ton used by the converted trend.
BUSHELS_PER_TON = "35.714"


def yield_trend(df: DataFrame, crop: str, variety: str | None = None,
                convert: bool = False) -> DataFrame:
    """Per year: harvested, planted, production and yield = production / harvested.

    ``crop`` / ``variety`` compare with ``commodity_name`` /
    ``commodity_class_variety`` (display names, as in the tidy table).  With
    ``convert``, also production x unit multiplier and production x 35.714.
    Partial sums per map task, one shuffle on ``year``, a small final sort.
    """
    cond = F.col("commodity_name") == crop
    if variety is not None:
        cond = cond & (F.col("commodity_class_variety") == variety)
    aggs = [F.sum("area_harvested").alias("harvested"), F.sum("area_planted").alias("planted"),
            F.sum("crop_production").alias("production")]
    if convert:
        aggs.append(F.sum(F.col("crop_production") * F.col("production_unit_multiplier")).alias("production_bu"))
    out = df.filter(cond).groupBy("year").agg(*aggs)
    out = out.withColumn("yield", safe_ratio("production", "harvested"))
    if convert:
        out = out.withColumn("production_converted",
                             F.col("production") * F.lit(BUSHELS_PER_TON).cast("decimal(5,3)"))
    return out.orderBy(F.col("year").asc_nulls_last())


def unit_yield_trend(df: DataFrame, by: Sequence[str] = ("year", "commodity_name")) -> DataFrame:
    """Yields in the crops' own yield units: production x ``production_to_yield_multiplier`` / harvested area.

    One row per ``by`` and yield unit, so bushels and tons of one crop are never added.  Production is reported in
    bales of cotton and hundredweights of rice, yields in pounds; the multiplier turns one into the other.  Sums are
    exact; only the last product and ratio are doubles.
    """
    units = ["yield_unit", "production_to_yield_multiplier"]
    out = df.groupBy(*by, *units).agg(F.sum("area_harvested").alias("harvested"), F.sum("crop_production").alias("production"))
    in_yield_unit = F.col("production").cast("double") * F.col("production_to_yield_multiplier")
    return (out.withColumn("production_in_yield_unit", in_yield_unit)
            .withColumn("yield", safe_ratio("production_in_yield_unit", "harvested")).drop("production_to_yield_multiplier"))
