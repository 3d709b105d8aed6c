"""Unit classification (production unit, conversion, multipliers, yield unit) and the
roll-up measure rules.  All rules are ordered ``when`` chains: first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longstats.functions.text import full_match

# Fixed values of the reference's unit rules.
BU_CROPS = ".*(CORN|SOYBEANS|WHEAT).*"
LB_CROPS = ".*(COTTON|RICE).*"
COTTON, RICE, CORN = "COTTON", "RICE", "CORN"
SILAGE, GRAIN = "SILAGE", "GRAIN"
TONS_PER_BUSHEL_FACTOR = "35.714"     # bushels per short ton (2000 lb / 56 lb)
BUSHELS_PER_TON_FACTOR = "0.028"
COTTON_BALE_LB = 480
RICE_CWT_LB = 100


def _is_silage(commodity: Column, cls: Column) -> Column:
    return (commodity == CORN) & (cls == SILAGE)


def unit_columns(commodity: str = "commodity_desc", cls: str = "commodity_class_desc") -> dict[str, Column]:
    """The five unit columns as expressions of commodity and effective class."""
    c, k = F.col(commodity), F.col(cls)
    silage = _is_silage(c, k)
    grain = (c == CORN) & (k == GRAIN)
    bu_crop = full_match(c, BU_CROPS, ignore_case=True)
    return {
        "production_unit": (F.when(silage, "TONS").when(bu_crop, "BU")
                            .when(c == COTTON, "480 LB BALES").when(c == RICE, "CWT")),
        "production_unit_conversion": (F.when(silage, "TONS TO BU").when(grain, "BU TO TONS")
                                       .otherwise("NO CONVERSION")),
        "production_unit_multiplier": (F.when(silage, F.lit(TONS_PER_BUSHEL_FACTOR).cast("decimal(5,3)"))
                                       .when(grain, F.lit(BUSHELS_PER_TON_FACTOR).cast("decimal(5,3)"))
                                       .otherwise(F.lit(1).cast("decimal(5,3)"))),
        "yield_unit": (F.when(silage, "TONS / ACRE").when(bu_crop, "BU / ACRE")
                       .when(full_match(c, LB_CROPS), "LB / ACRE")),
        "production_to_yield_multiplier": (F.when(bu_crop, F.lit(1.0)).when(c == COTTON, F.lit(float(COTTON_BALE_LB)))
                                           .when(c == RICE, F.lit(float(RICE_CWT_LB)))).cast("double"),
    }


def classify_units(df: DataFrame, commodity: str = "commodity_desc",
                   cls: str = "commodity_class_desc") -> DataFrame:
    """Append the unit columns.

    They depend only on commodity and effective class, so apply this after the
    group-by (on the aggregated rows) rather than carrying five ANY_VALUEs
    through the shuffle.
    """
    return df.withColumns(unit_columns(commodity, cls))


def rollup_measures(num: Column, commodity: str = "commodity_desc",
                    cls: str = "commodity_class_desc", statistic: str = "statisticcat_desc",
                    unit: str = "unit_desc") -> dict[str, Column]:
    """Per-row measure contributions for the four roll-up measures (NULL when the row
    does not feed the measure).  Sum them to pivot statistics into columns."""
    c, k, s, u = F.col(commodity), F.col(cls), F.col(statistic), F.col(unit)
    silage = _is_silage(c, k)
    production, yld = s == "PRODUCTION", s == "YIELD"
    return {
        "area_planted": F.when((s == "AREA PLANTED") & (u == "ACRES"), num),
        "area_harvested": F.when((s == "AREA HARVESTED") & (u == "ACRES"), num),
        # branch order matters: corn silage reported in BU falls through to the BU branch
        "crop_production": (F.when(production & (u == "TONS") & silage, num)
                            .when(production & (u == "BU") & full_match(c, BU_CROPS, ignore_case=True), num)
                            .when(production & (u == "480 LB BALES") & (c == COTTON), num)
                            .when(production & (u == "CWT") & (c == RICE), num)),
        "crop_yield": (F.when(yld & (u == "TONS / ACRE") & silage, num)
                       .when(yld & (u == "BU / ACRE") & full_match(c, BU_CROPS), num)
                       .when(yld & (u == "LB / ACRE") & full_match(c, LB_CROPS), num)),
    }
