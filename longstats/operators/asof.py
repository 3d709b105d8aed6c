"""As-of join: every row with the latest entry of its key that is not after it.

Rows and entries are put in one sequence (a union), ordered by key and time,
entries first at equal times; each row takes the last entry before it.  The
sequence is range-partitioned by (key, time), so a key that holds a third of
all rows is cut into several ranges; inside a range the last entry is a window
over (key, range), and what a range starts with is the last entry of the ranges
before it (one row per key and range).  There is no join of rows with entries,
so nothing is multiplied however many entries a key has.

Rows without a key or a time match nothing; they are set apart before the
shuffle, so a table of mostly NULL keys has no hot task.  Of several entries of
one key and time the greatest by their columns is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from longstats.session import materialize


def _known(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return cond


def _struct_type(df: DataFrame, columns: Sequence[str]) -> DataType:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s")).schema["s"].dataType


def asof_join(rows: DataFrame, entries: DataFrame, keys: Sequence[str], time: str, entry_time: str,
              columns: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """The columns of ``rows``, then ``entry_time`` and ``columns`` of the entry found (NULL: none).

    ``keys`` are columns of both.  With ``tolerance`` an entry that is further back than that isn't taken.
    """
    found = [entry_time, *columns]
    if clash := set(found) & set(rows.columns):
        raise ValueError(f"{sorted(clash)} are columns of the rows already")
    names = [f"_k{i}" for i in range(len(keys))]
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    none = F.lit(None).cast(_struct_type(entries, found))
    # one entry per key and time
    kept = (entries.filter(_known([*keys, entry_time])).groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(entry_time).alias("_t"))
            .agg(F.max(F.struct(*[F.col(f"`{c}`") for c in found])).alias("_found")))
    line = (rows.filter(_known([*keys, time]))
            .select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{time}`").alias("_t"), F.lit(1).alias("_side"),
                    own.alias("_row"), none.alias("_found"))
            .unionByName(kept.select(*names, "_t", F.lit(0).alias("_side"), F.lit(None).cast(_struct_type(rows, rows.columns)).alias("_row"), "_found")))
    by = [*names, "_t", "_side"]
    # written, so that the ranges stay what they are for all that reads them
    ranged = materialize(line.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "asof-ranges")
    inside = Window.partitionBy(*names, "_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_last", F.last("_found", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range
    carried = (ranged.groupBy(*names, "_range").agg(F.max_by("_found", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
               .withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
               .select(*names, "_range", "_carried").filter(F.col("_carried").isNotNull()))
    joined = local.join(carried, [*names, "_range"], "left")
    entry = F.coalesce(F.col("_last"), F.col("_carried"))
    if tolerance is not None:
        entry = F.when(F.col("_t") - entry[entry_time] <= tolerance, entry)
    matched = joined.select("_row", entry.alias("_found"))
    apart = rows.filter(~_known([*keys, time])).select(own.alias("_row"), none.alias("_found"))
    both = matched.unionByName(apart)
    return both.select(*[F.col("_row")[c].alias(c) for c in rows.columns], *[F.col("_found")[c].alias(c) for c in found])
