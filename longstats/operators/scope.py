"""Row scoping: core filter, level filter, effective class, presence tests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longstats.functions.text import full_match

# Fixed values of the reference job.
CROP_PATTERN = ".*(corn|soy|wheat|cotton|rice).*"   # matched case-insensitively, whole value
EXCLUDED_CROPS = ("SWEET CORN",)
DEFAULT_MIN_YEAR = 1990
ROLLUP_STATISTICS = ("AREA HARVESTED", "AREA PLANTED", "YIELD", "PRODUCTION")
SURVEY = "SURVEY"
ANNUAL_PERIOD = "YEAR"
ALL_PRACTICES = "ALL PRODUCTION PRACTICES"
CORN = "CORN"
AREA_PLANTED = "AREA PLANTED"
PLANTED_ONLY_CLASS = "AREA PLANTED (ONLY)"


def crop_filter(commodity: str = "commodity_desc", pattern: str = CROP_PATTERN) -> Column:
    """Commodity matches the crop pattern as a whole value, ignoring case.

    Substring semantics on purpose: POPCORN, BUCKWHEAT and anything containing
    RICE pass too, as in the reference.
    """
    return full_match(commodity, pattern, ignore_case=True)


def core_scope(df: DataFrame, min_year: int = DEFAULT_MIN_YEAR, include: str = CROP_PATTERN,
               exclude: Iterable[str] = EXCLUDED_CROPS) -> DataFrame:
    """``year >= min_year`` and crop pattern and not an excluded commodity.

    The year test reaches the Parquet scan as a pushed filter (and prunes
    ``year=`` partitions of a laid-out table); the regex stays a Filter.
    """
    cond = (F.col("year") >= F.lit(min_year)) & crop_filter("commodity_desc", include)
    for name in exclude:
        cond = cond & ~(F.col("commodity_desc") == F.lit(name))
    return df.filter(cond)


def level_scope(df: DataFrame, level: str | Iterable[str], source: str | None = SURVEY,
                period: str | None = ANNUAL_PERIOD, practice: str | None = ALL_PRACTICES,
                statistics: Iterable[str] | None = ROLLUP_STATISTICS) -> DataFrame:
    """Equality conjunction selecting one (or several) aggregation levels of survey rows.

    Every test is a plain comparison, so all of them are pushed to the scan.
    Pass ``None`` to drop a test.
    """
    levels = [level] if isinstance(level, str) else list(level)
    cond = F.col("agg_level_desc").isin(levels) if len(levels) > 1 else F.col("agg_level_desc") == levels[0]
    if source is not None:
        cond = cond & (F.col("source_desc") == source)
    if statistics is not None:
        cond = cond & F.col("statisticcat_desc").isin(list(statistics))
    if period is not None:
        cond = cond & (F.col("reference_period_desc") == period)
    if practice is not None:
        cond = cond & (F.col("prodn_practice_desc") == practice)
    return df.filter(cond)


def effective_class(commodity: str = "commodity_desc", statistic: str = "statisticcat_desc",
                    util: str = "util_practice_desc", cls: str = "class_desc") -> Column:
    """Class used for roll-ups: corn is split by utilisation practice (grain,
    silage, ...) except planted area, which corn reports only as a total."""
    is_corn = F.col(commodity) == CORN
    return (F.when(is_corn & (F.col(statistic) != AREA_PLANTED), F.col(util))
             .when(is_corn & (F.col(statistic) == AREA_PLANTED), F.lit(PLANTED_ONLY_CLASS))
             .otherwise(F.col(cls)))


def any_present(*cols: str) -> Column:
    """True when at least one of the columns is not NULL."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
