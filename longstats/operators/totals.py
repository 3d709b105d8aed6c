"""Totals at several levels in one pass (grouping sets), told from NULL values.

The measures are first summed to the finest of the levels, combined map-side;
the rows that Spark's Expand then repeats, once per level, are those sums and
not the table, so the repetition costs little however many levels are asked
for.  Sums, counts, least and greatest values can be taken from such sums;
averages are made of a sum and a count at the end.

Each result row says by ``level`` which set it belongs to, and by
``level_id`` (Spark's ``grouping_id``, a bit per key from the left, 1 where the
key is totalled).  A NULL key with its bit 0 is a group of rows whose key is
NULL; with its bit 1 it is a total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_sets(keys: Sequence[str]) -> dict[str, list[str]]:
    """The levels of a roll-up: all keys, all but the last, ..., none; named by their last key."""
    return {(keys[n - 1] if n else "all"): list(keys[:n]) for n in range(len(keys), -1, -1)}


def cube_sets(keys: Sequence[str]) -> dict[str, list[str]]:
    """Every combination of the keys; named by them."""
    return {",".join(c) or "all": list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)}


def level_totals(df: DataFrame, levels: Mapping[str, Sequence[str]], sums: Sequence[str] = (),
                 averages: Sequence[str] = (), least: Sequence[str] = (), greatest: Sequence[str] = (),
                 rows: str = "row_count") -> DataFrame:
    """One row per group of each level: its keys (NULL where totalled), ``level``, ``level_id``, the number of rows and
    the measures (``average_x``, ``least_x``, ``greatest_x``; sums under their own names).

    ``levels`` names sets of columns; sets must differ.  A level without keys is one row, of all rows (none if there
    are no rows).
    """
    if len({frozenset(s) for s in levels.values()}) < len(levels) or not levels:
        raise ValueError("levels must be at least one, and differ")
    keys = list(dict.fromkeys(k for s in levels.values() for k in s))
    if clash := set(keys) & {"level", "level_id", rows, *sums}:
        raise ValueError(f"{sorted(clash)} are names of the result")
    plain: list[tuple[str, Column, str]] = [(rows, F.count(F.lit(1)), "sum")]
    plain += [(m, F.sum(m), "sum") for m in sums]
    plain += [p for m in averages for p in ((f"_sum_{m}", F.sum(m), "sum"), (f"_n_{m}", F.count(m), "sum"))]
    plain += [(f"least_{m}", F.min(m), "min") for m in least] + [(f"greatest_{m}", F.max(m), "max") for m in greatest]
    # the same keys finely: NULL is a group of its own
    fine = df.groupBy(*keys).agg(*[c.alias(n) for n, c, _ in plain])
    again = [getattr(F, how)(n).alias(n) for n, _, how in plain]
    if keys:
        sets = [[F.col(k) for k in s] for s in levels.values()]
        out = fine.groupingSets(sets, *keys).agg(*again, F.grouping_id().alias("level_id"))
    else:
        out = fine.agg(*again).withColumn("level_id", F.lit(0).cast("long"))
    name = F.lit(None).cast("string")
    for level, s in levels.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        name = F.when(F.col("level_id") == bits, F.lit(level)).otherwise(name)
    shown = [F.col(rows), *[F.col(m) for m in sums],
             *[(F.col(f"_sum_{m}").cast("double") / F.when(F.col(f"_n_{m}") > 0, F.col(f"_n_{m}"))).alias(f"average_{m}") for m in averages],
             *[F.col(f"least_{m}") for m in least], *[F.col(f"greatest_{m}") for m in greatest]]
    # a total over nothing isn't a group
    return out.filter(F.col(rows) > 0).select(name.alias("level"), "level_id", *keys, *shown)


def at_level(totals: DataFrame, levels: Mapping[str, Sequence[str]], level: str) -> DataFrame:
    """The rows of one level, without the keys that it totals."""
    keys = list(dict.fromkeys(k for s in levels.values() for k in s))
    gone = [k for k in keys if k not in levels[level]]
    return totals.filter(F.col("level") == level).drop("level", "level_id", *gone)
