"""Ordered calculations over series: change against the period before, moving figures, running totals, ranks, tops.

Periods are compared by their value, not by their place: frames are ranges
(``RANGE BETWEEN``), so a year that a series lacks stays a gap and the year
before a gap is not taken for the previous one.

A series of yearly figures is first summed to one row per period, so a window
over it holds as many rows as there are periods.  Where the order is finer
(counties, values, identifiers), one series can hold a third of all rows;
``running_total`` and ``ranked`` then work over ranges: the points are
range-partitioned by (series, order), which cuts a long series into several
ranges, each range is summed on its own, and the sums of the ranges before it
(one row per series and range) are added.  No window spans a whole hot series,
and none is without partition keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longstats.session import materialize


def by_period(df: DataFrame, series: Sequence[str], measures: Sequence[str], period: str = "year") -> DataFrame:
    """One row per series and period: the measures' sums (NULL where no row has one)."""
    return df.groupBy(*series, period).agg(*[F.sum(m).alias(m) for m in measures])


def change_on_previous(df: DataFrame, series: Sequence[str], measure: str, period: str = "year", back: int = 1) -> DataFrame:
    """``series, period, measure, previous, change, change_ratio`` against the period ``back`` before.

    ``previous`` is NULL if the series has no such period (or no figure for it).  Periods are whole numbers; rows of a
    NULL period are a period of their own, without a previous one.
    """
    points = by_period(df, series, [measure], period)
    then = Window.partitionBy(*series).orderBy(period).rangeBetween(-back, -back)
    # a NULL period's range is the NULL period itself
    previous = F.when(F.col(period).isNotNull(), F.sum(measure).over(then))
    change = F.col(measure) - F.col("previous")
    ratio = change.cast("double") / F.when(F.col("previous") != 0, F.col("previous").cast("double"))
    return points.withColumn("previous", previous).withColumns({"change": change, "change_ratio": ratio})


def moving_sums(df: DataFrame, series: Sequence[str], measures: Sequence[str], width: int, period: str = "year") -> DataFrame:
    """``series, period``, the measures summed over the last ``width`` periods, and how many of those there are (``periods``)."""
    points = by_period(df, series, measures, period)
    frame = Window.partitionBy(*series).orderBy(period).rangeBetween(-(width - 1), 0)
    return points.select(*series, period, *[F.sum(m).over(frame).alias(m) for m in measures],
                         F.count(F.lit(1)).over(frame).alias("periods"))


def moving_ratio(df: DataFrame, series: Sequence[str], top: str, bottom: str, name: str, width: int = 3,
                 period: str = "year", complete: bool = False) -> DataFrame:
    """A ratio of moving sums (a yield: production over area).  With ``complete`` it is NULL where a period lacks."""
    sums = moving_sums(df, series, [top, bottom], width, period)
    ratio = F.col(top).cast("double") / F.when(F.col(bottom) != 0, F.col(bottom).cast("double"))
    return sums.withColumn(name, F.when(F.col("periods") == width, ratio) if complete else ratio)


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def _over_ranges(points: DataFrame, series: Sequence[str], order: str, descending: bool, sums: Sequence[str]) -> DataFrame:
    """Distinct (series, order) points with each of ``sums`` also as its running total ``running_x``, this point included."""
    place = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    by = [*[F.col(s).asc() for s in series], place]
    # written, so that the ranges stay what they are for all that reads them
    ranged = materialize(points.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*series, "_range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums}).alias("p")
    earlier = Window.partitionBy(*series).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per series and range
    before = (ranged.groupBy(*series, "_range").agg(*[F.sum(s).alias(f"_all_{s}") for s in sums])
              .select(*series, "_range", *[F.sum(f"_all_{s}").over(earlier).alias(f"_before_{s}") for s in sums])).alias("b")
    joined = local.join(before, _same("p", "b", series) & (F.col("p._range") == F.col("b._range")))

    def total(s: str) -> Column:
        both = F.coalesce(F.col(f"_before_{s}"), F.lit(0)) + F.coalesce(F.col(f"_in_{s}"), F.lit(0))
        return F.when(F.col(f"_before_{s}").isNotNull() | F.col(f"_in_{s}").isNotNull(), both).alias(f"running_{s}")

    return joined.select(*[F.col(f"p.{c}").alias(c) for c in points.columns], *map(total, sums))


def running_total(df: DataFrame, series: Sequence[str], order: str, measure: str, descending: bool = False) -> DataFrame:
    """``series, order, measure, running_measure``: one row per distinct (series, order), ties summed together.

    NULLs of ``order`` come last.  The running total is NULL up to the first figure.
    """
    points = df.groupBy(*series, order).agg(F.sum(measure).alias(measure))
    return _over_ranges(points, series, order, descending, [measure])


def ranked(df: DataFrame, within: Sequence[str], value: str, name: str = "place", descending: bool = True) -> DataFrame:
    """Every row with its rank by ``value`` inside its group (ties share a rank, gaps after them) and ``name``_dense.

    Ranks are running counts over the group's distinct values, joined back by value: a value that a third of the rows
    share is one point, and its rows are never sorted.  NULLs rank last.
    """
    points = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    counted = _over_ranges(points, within, value, descending, ["_n", "_one"])
    places = counted.select(*within, value, (F.col("running__n") - F.col("_n") + 1).alias(name),
                            F.col("running__one").alias(f"{name}_dense")).alias("v")
    rows = df.alias("d")
    return (rows.join(places, _same("d", "v", [*within, value]))
            .select(*[F.col(f"d.{c}").alias(c) for c in df.columns], name, f"{name}_dense"))


def top_per_group(df: DataFrame, within: Sequence[str], order: Sequence[Column], n: int, ties: bool = True,
                  name: str = "place") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their place.

    With ``ties`` every row that shares the last place comes along (rank), else ``order`` decides alone and must be
    total for a reproducible result (row number).  The limit is applied in every task before the shuffle (a window group
    limit), so a hot group sends ``n`` rows per task, or with ties those that tie.
    """
    place = F.rank() if ties else F.row_number()
    return df.withColumn(name, place.over(Window.partitionBy(*within).orderBy(*order))).filter(F.col(name) <= n)
