"""Totals beside groups: grand total and partition totals, without windows.

``sum().over(Window.partitionBy())`` moves every row into a single partition,
and ``sum().over(Window.partitionBy(k))`` puts all rows of a hot key into one
task.  Instead, the grand total is a scalar subquery, and partition totals are
an aggregate (combined map-side first) joined back: a broadcast of the small,
AQE-measured totals, or a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_grand_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Append ``sum(measure)`` over all rows as column ``name``.

    The total is a scalar subquery (a partial-then-final aggregate that yields
    one value); every row then reads that value, with no join and no window.
    """
    return df.withColumn(name, df.agg(F.sum(measure)).scalar())


def with_partition_total(df: DataFrame, by: Sequence[str], measure: str, name: str) -> DataFrame:
    """Append ``sum(measure)`` per ``by`` group to every row (NULL keys form a group)."""
    totals = df.groupBy(*by).agg(F.sum(measure).alias(name)).alias("t")
    base = df.alias("d")
    cond = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    return base.join(totals, cond, "left").select("d.*", F.col(f"t.{name}"))
