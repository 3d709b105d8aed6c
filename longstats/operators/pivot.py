"""Conditional-sum pivot: one output column per measure, each summing the rows that
satisfy that measure's own condition, in a single aggregation pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _contribution(spec: Column | tuple[Column, Column]) -> Column:
    if isinstance(spec, tuple):
        cond, value = spec
        return F.when(cond, value)
    return spec


def conditional_pivot(df: DataFrame, keys: Sequence[str | Column],
                      measures: Mapping[str, Column | tuple[Column, Column]]) -> DataFrame:
    """``groupBy(keys).agg(sum(when(cond, value)) ...)``.

    ``measures`` maps an output name to ``(condition, value)`` or to a ready
    conditional expression.  A group with no matching row gets NULL, not 0.
    ``groupBy().pivot()`` does not fit because every measure has its own
    condition.  Spark aggregates partially on the map side, so a hot group
    key reaches the shuffle as one row per map task.
    """
    return df.groupBy(*keys).agg(*[F.sum(_contribution(spec)).alias(name)
                                   for name, spec in measures.items()])


def source_stat_measures(num: Column, sources: Sequence[str] = ("CENSUS", "SURVEY"),
                         domain: str = "TOTAL") -> dict[str, Column]:
    """Measure spec of the census-vs-survey pivot: source x statistic, 8 columns."""
    stats = [("AREA PLANTED", "area_planted"), ("AREA HARVESTED", "area_harvested"),
             ("YIELD", "area_yield"), ("PRODUCTION", "area_production")]
    out: dict[str, Column] = {}
    for stat, prefix in stats:
        for source in sources:
            cond = ((F.col("source_desc") == source) & (F.col("domain_desc") == domain)
                    & (F.col("statisticcat_desc") == stat))
            out[f"{prefix}_{source.lower()}"] = F.when(cond, num)
    return out
