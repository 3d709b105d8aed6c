"""Array aggregates and reference NULL ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_set(c: str | Column) -> Column:
    """Distinct non-NULL values of a group, ascending (``ARRAY_AGG(DISTINCT x) ORDER BY x``).

    Only use on groups whose distinct values are bounded by a small domain
    (years, commodities), never on raw row streams.
    """
    return F.array_sort(F.collect_set(_col(c)))


def ordered_list(value: str | Column, by: str | Column) -> Column:
    """Non-NULL values of a group ordered by ``by``, ties broken by value
    (``ARRAY_AGG(value) WITHIN GROUP (ORDER BY by)``)."""
    v = _col(value)
    pairs = F.collect_list(F.when(v.isNotNull(), F.struct(_col(by).alias("k"), v.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])


def asc_ref(c: str | Column) -> Column:
    """Ascending with NULLs last (the reference's default; Spark's is NULLs first)."""
    return _col(c).asc_nulls_last()


def desc_ref(c: str | Column) -> Column:
    """Descending with NULLs first (the reference's default; Spark's is NULLs last)."""
    return _col(c).desc_nulls_first()
