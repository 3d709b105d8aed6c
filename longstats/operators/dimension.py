"""The county dimension beside the statistics: joined by the FIPS text code, in versions, with a report of what matched.

Rows without a key are set apart before the join: they can match nothing, and
all of them would meet in one task of a shuffle.  The others are a left join on
the code, for which Spark broadcasts the dimension if its measured size allows,
else sorts both sides, splits skewed partitions and filters the rows by the
dimension's keys at run time where that pays.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHED, UNMATCHED, NULL_KEY = "matched", "unmatched", "null_key"


def fips_text(code: str | Column) -> Column:
    """A county's code as five digits: numbers lose their leading zero in some files.  Anything else is NULL."""
    c = F.trim(F.col(code) if isinstance(code, str) else code)
    return F.when(c.rlike("^[0-9]{4,5}$"), F.lpad(c, 5, "0"))


def duplicate_keys(dimension: DataFrame, key: str) -> DataFrame:
    """Keys that several dimension rows share (NULLs aside), with their number."""
    return (dimension.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("dimension_rows"))
            .filter(F.col("dimension_rows") > 1))


def join_dimension(rows: DataFrame, dimension: DataFrame, row_key: str, dimension_key: str, columns: Sequence[str],
                   status: str = "match") -> DataFrame:
    """The rows with ``columns`` of their dimension entry and ``status``: matched, unmatched or null_key.

    Every row is kept once; a dimension with two rows of one key raises, as it would multiply the rows.
    """
    if clash := {*columns, status} & set(rows.columns):
        raise ValueError(f"{sorted(clash)} are columns of the rows already")
    if not (twice := duplicate_keys(dimension, dimension_key)).isEmpty():
        raise ValueError(f"the dimension has keys more than once, such as {twice.first()[0]!r}")
    entries = dimension.filter(F.col(dimension_key).isNotNull()).select(
        F.col(dimension_key).alias("_key"), *columns, F.lit(True).alias("_there"))
    keyed = (rows.filter(F.col(row_key).isNotNull()).join(entries, F.col(row_key) == F.col("_key"), "left")
             .select(*[F.col(f"`{c}`") for c in rows.columns], *columns,
                     F.when(F.col("_there"), MATCHED).otherwise(UNMATCHED).alias(status)))
    apart = rows.filter(F.col(row_key).isNull()).select(
        "*", *[F.lit(None).cast(dimension.schema[c].dataType).alias(c) for c in columns], F.lit(NULL_KEY).alias(status))
    return keyed.unionByName(apart)


def match_summary(rows: DataFrame, dimension: DataFrame, row_key: str, dimension_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per status and group, and how many distinct keys they have.

    The rows are counted per key first, so what is joined is one row per key and group.
    """
    counted = rows.groupBy(*by, row_key).agg(F.count(F.lit(1)).alias("_n"))
    told = join_dimension(counted, dimension, row_key, dimension_key, [])
    return told.groupBy(*by, "match").agg(F.sum("_n").alias("row_count"), F.count_distinct(row_key).alias("key_count"))


def dimension_versions(dimension: DataFrame, key: str, names: Mapping[str, str], years: Mapping[int, int] | Sequence[int],
                       year: str = "code_year") -> DataFrame:
    """A wide dimension (a column per code and edition, such as ``metro2013``) as one row per key and edition.

    ``names`` maps result columns to the codes' column stems, ``years`` lists the editions (or maps them to the year from
    which they hold).  An edition without any of the codes for a key is left out.
    """
    valid_from = dict(years) if isinstance(years, Mapping) else {y: y for y in years}
    have = {c.lower(): c for c in dimension.columns}
    editions = []
    for edition, since in valid_from.items():
        if lacking := [s for s in names.values() if f"{s}{edition}".lower() not in have]:
            raise ValueError(f"the dimension has no {edition} edition of {lacking}")
        editions.append(F.struct(F.lit(since).alias(year), *[F.col(have[f"{stem}{edition}".lower()]).alias(n) for n, stem in names.items()]))
    some = F.lit(False)
    for n in names:
        some = some | F.col(n).isNotNull()
    return dimension.select(key, F.inline(F.array(*editions))).filter(some)


def edition_stems(columns: Sequence[str], editions: Sequence[int]) -> list[str]:
    """The code stems that a wide dimension has in all of ``editions``."""
    found = [{m.group(1).lower() for c in columns if (m := re.fullmatch(rf"(.+?){e}", c))} for e in editions]
    return sorted(set.intersection(*found))
