"""Load checks and data profiles used to understand a long statistics table.

Each profile is a distributed aggregate; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longstats.functions.collections import desc_ref, ordered_list, sorted_set
from longstats.functions.numbers import parse_grouped_decimal, year_date
from longstats.operators.pivot import conditional_pivot, source_stat_measures
from longstats.operators.scope import (
    ANNUAL_PERIOD,
    ROLLUP_STATISTICS,
    SURVEY,
    crop_filter,
)
from longstats.operators.windows import with_partition_total


def check_load(df: DataFrame, expected: int | DataFrame, probes: Column | None = None) -> DataFrame:
    """One row: ``row_count``, ``expected_rows``, ``rows_match`` and ``probe_rows``
    (rows satisfying the ``probes`` predicate, e.g. the first and last source row).

    ``expected`` is a number, or a DataFrame whose row count is expected (counted
    by Spark, as a scalar subquery).
    """
    probe = probes if probes is not None else F.lit(False)
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(probe).alias("probe_rows"))
    if isinstance(expected, DataFrame):
        expected_col = expected.select(F.count(F.lit(1))).scalar()
    else:
        expected_col = F.lit(int(expected)).cast("bigint")
    return counts.select("row_count", expected_col.alias("expected_rows"), "probe_rows").withColumn(
        "rows_match", F.col("row_count") == F.col("expected_rows"))


def row_count(df: DataFrame) -> DataFrame:
    """``count(*)`` (0 on empty input) and ``sum(1)`` (NULL on empty input)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.lit(1)).alias("row_sum"))


def period_profile(df: DataFrame, *cols: str) -> DataFrame:
    """Row count per combination of ``cols`` (``SUM(1)``)."""
    return df.groupBy(*cols).agg(F.sum(F.lit(1)).cast("bigint").alias("row_count"))


def distinct_combos(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Distinct value combinations of ``cols`` (GROUP BY without aggregates)."""
    rows = df.filter(where) if where is not None else df
    return rows.select(*cols).distinct()


def null_key_levels(df: DataFrame, key: str = "state_name", level: str = "agg_level_desc") -> DataFrame:
    """Levels that have rows with a NULL ``key``."""
    return distinct_combos(df, [level], F.col(key).isNull())


def names_shared(df: DataFrame, name: str = "county_name", owner: str = "state_name") -> DataFrame:
    """How many distinct owners use each name, most shared first."""
    return (df.groupBy(name).agg(F.count_distinct(owner).alias("state_count"))
            .orderBy(desc_ref("state_count")))


def coverage_profile(df: DataFrame, entity: str = "state_name", period: str = "year",
                     item: str = "commodity_desc") -> DataFrame:
    """Per entity: sorted periods, sorted items, period-item labels ordered by period,
    and the item count.

    Rows are first reduced to distinct (entity, period, item) triples (a map-side
    combined aggregate), so the arrays are bounded by periods x items, not by
    the row count of a hot entity.
    """
    triples = (df.select(entity, period, item).distinct()
               .withColumn("period_item", F.concat(F.col(period).cast("string"), F.lit("-"), F.col(item))))
    return (triples.groupBy(entity)
            .agg(sorted_set(period).alias("production_years"),
                 sorted_set(item).alias("commodities_produced"),
                 ordered_list("period_item", period).alias("commodities_produced_year"))
            .withColumn("unique_commodities", F.size("commodities_produced"))
            .orderBy(desc_ref("unique_commodities")))


def numeric_format_profile(df: DataFrame, col: str = "value") -> DataFrame:
    """Widest grouped number (count of group separators) and most decimals."""
    c = F.col(col)
    decimals = F.nullif(F.regexp_extract(c, r"\d+\.(\d+)", 1), F.lit(""))
    return df.agg(F.max(F.regexp_count(c, F.lit(","))).alias("max_place_value"),
                  F.max(F.length(decimals)).alias("max_decimal_places"))


def unit_inventory(df: DataFrame) -> DataFrame:
    """Distinct statistic x unit x commodity of the survey roll-up statistics."""
    rows = df.filter(crop_filter() & F.col("statisticcat_desc").isin(list(ROLLUP_STATISTICS))
                     & (F.col("source_desc") == SURVEY))
    return (rows.select("statisticcat_desc", "unit_desc", "commodity_desc").distinct()
            .orderBy("statisticcat_desc", "unit_desc", "commodity_desc"))


def variety_from_label(label: str | Column = "short_desc") -> dict[str, Column]:
    """Group (text before `` - ``) and variety (3rd, else 2nd comma piece) of a label.
    Pieces keep their leading space, as in the reference."""
    lab = F.col(label) if isinstance(label, str) else label
    group = F.split_part(lab, F.lit(" - "), F.lit(1))
    variety = F.coalesce(F.nullif(F.split_part(group, F.lit(","), F.lit(3)), F.lit("")),
                         F.nullif(F.split_part(group, F.lit(","), F.lit(2)), F.lit("")))
    return {"commodity_group": group, "commodity_variety": variety}


LABEL_KEYS = ["commodity_desc", "statisticcat_desc", "short_desc", "class_desc", "util_practice_desc",
              "unit_desc", "prodn_practice_desc", "domain_desc", "commodity_group"]


def label_breakdown(df: DataFrame, level: str, year: int, practice: str | None = None) -> DataFrame:
    """Value per label with its variety, beside the total of its
    (commodity, statistic, unit) partition."""
    cond = ((F.col("year") == year) & crop_filter() & (F.col("source_desc") == SURVEY)
            & (F.col("reference_period_desc") == ANNUAL_PERIOD) & (F.col("agg_level_desc") == level)
            & F.col("statisticcat_desc").isin(list(ROLLUP_STATISTICS)))
    if practice is not None:
        cond = cond & (F.col("prodn_practice_desc") == practice)
    labelled = df.filter(cond).withColumns(variety_from_label()).withColumn(
        "num", parse_grouped_decimal("value", 38, 3))
    agg = labelled.groupBy(*LABEL_KEYS).agg(F.sum("num").alias("value_number"))
    agg = agg.withColumn("commodity_variety", variety_from_label("short_desc")["commodity_variety"])
    return with_partition_total(agg, ["commodity_desc", "statisticcat_desc", "unit_desc"],
                                "value_number", "total_value")


def varied_classes(core: DataFrame, group: str = "commodity_desc", cls: str = "class_desc") -> DataFrame:
    """All (group, class) pairs of groups that report more than one class.

    Both sides come from one distinct aggregate of the pairs, so only pairs are joined.
    """
    pairs = core.select(group, cls).distinct()
    varied = pairs.groupBy(group).agg(F.count(cls).alias("n")).filter(F.col("n") > 1).select(group)
    return pairs.join(varied, group, "left_semi").select(group, cls).orderBy(group, cls)


SOURCE_STAT_KEYS = ["year", "commodity_desc", "class_desc", "prodn_practice_desc", "util_practice_desc",
                    "unit_desc", "state_alpha", "state_name"]


def source_stat_pivot(core: DataFrame, level: str = "COUNTY") -> DataFrame:
    """Census vs survey side by side for planted, harvested, yield and production
    (8 measures) of acre-unit rows, each value rounded to an integer first."""
    rows = core.filter((F.col("agg_level_desc") == level)
                       & F.col("statisticcat_desc").isin(list(ROLLUP_STATISTICS))
                       & (F.col("reference_period_desc") == ANNUAL_PERIOD)
                       & (F.col("unit_desc") == "ACRES"))
    # parse once per row; the eight measures all read the parsed value
    rows = rows.withColumn("num", parse_grouped_decimal("value", 38, 0))
    measures = source_stat_measures(F.col("num"))
    out = conditional_pivot(rows, SOURCE_STAT_KEYS, measures)
    return out.withColumn("year_date", year_date("year")).select(
        "year", "year_date", *SOURCE_STAT_KEYS[1:], *measures.keys())


def distinct_nondefault(df: DataFrame, col: str, default: str, select: str = "commodity_desc") -> DataFrame:
    """Values of ``select`` that have rows where ``col`` differs from ``default``
    (NULL ``col`` does not count)."""
    return distinct_combos(df, [select], F.col(col) != default)
