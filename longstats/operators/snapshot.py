"""Difference of two loads of a table, as multisets.

Rows are compared by a 128-bit hash of all compared columns, NULLs told from
values, and counted: each side is combined map-side to (hash, count), one
shuffle brings the two counts of a hash together.  Only the hashes whose counts
differ go back to the tables to fetch their rows, so what is moved of the rows
themselves is the difference, not the tables (the list of differing hashes is
broadcast if its measured size allows, else joined by hash).  ``snapshot_diff``
first drops the rows whose hash can't be in the list by a bitmap of it (16 MB at
most), so that a long list doesn't make it shuffle both tables whole.

Repeated rows count: a row that the old load has three times and the new one
once is removed twice (EXCEPT ALL); what both have, as often as the rarer, is
kept (INTERSECT ALL).  Results give one row per distinct row with its number
of ``copies``, so a row that a third of the table repeats is one row; ``expand``
writes the copies out.

Two different rows with equal hashes would be taken for one: at 2^40 distinct
rows the chance that any two are is below 2^-48.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, BEFORE, AFTER = "added", "removed", "before", "after"


#: Places of the bitmap of differing hashes, and those of one of its rows (``bitmap_construct_agg`` makes 4 KB).
BITMAP, BITMAP_ROW = 2 ** 27, 2 ** 15


def row_hash(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row.

    Spark's hashes skip NULLs, so a flag per column goes in first: (NULL, 'a') and ('a', NULL) differ.
    """
    flags = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in columns])
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(flags, *values), F.xxhash64(F.lit("second"), flags, *values)


def _columns(old: DataFrame, new: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = list(columns or new.columns)
    if not names or len(set(names)) < len(names):
        raise ValueError("the compared columns must be at least one, each once")
    for df in (old, new):
        if lacking := [c for c in names if c not in df.columns]:
            raise ValueError(f"a load lacks the columns {lacking}")
    for c in names:
        if old.schema[c].dataType != new.schema[c].dataType:
            raise ValueError(f"{c} is {old.schema[c].dataType.simpleString()} in the old load and "
                             f"{new.schema[c].dataType.simpleString()} in the new one")
    return names


def _hashed(df: DataFrame, names: Sequence[str], *also: str) -> DataFrame:
    h1, h2 = row_hash(names)
    return df.select(h1.alias("_h1"), h2.alias("_h2"), *[F.col(f"`{c}`") for c in also])


def row_counts(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``_h1, _h2, n_old, n_new`` per distinct row of either load (and the columns ``by``, which must be compared ones)."""
    names = _columns(old, new, columns)
    if strange := [c for c in by if c not in names]:
        raise ValueError(f"{strange} are not compared")
    sides = [_hashed(df, names, *by).withColumns({"o": F.lit(o), "n": F.lit(n)}) for df, o, n in ((old, 1, 0), (new, 0, 1))]
    return (sides[0].unionByName(sides[1]).groupBy("_h1", "_h2", *by)
            .agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new")))


def _maybe_in(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows whose hash may be one of ``counts``: all that are, and few others."""
    place = F.pmod(F.col("_h1"), F.lit(BITMAP))
    bit = F.pmod(place, F.lit(BITMAP_ROW))
    bitmaps = counts.groupBy(F.floor(place / BITMAP_ROW).alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0
    names = rows.columns
    return (rows.withColumn("_part", F.floor(place / BITMAP_ROW)).join(F.broadcast(bitmaps), "_part")
            .filter(found).select(*[f"`{c}`" for c in names]))


def _fetched(df: DataFrame, names: Sequence[str], counts: DataFrame, sift: bool = False) -> DataFrame:
    """One row of ``df`` per hash of ``counts``, with the columns of ``counts`` (``sift``: by a bitmap first; ``counts`` are read twice)."""
    rows = _hashed(df, names, *names)
    rows = (_maybe_in(rows, counts) if sift else rows).join(counts, ["_h1", "_h2"])
    # equal hashes are equal rows: any of them stands for all
    others = [c for c in counts.columns if c not in ("_h1", "_h2")]
    picked = rows.groupBy("_h1", "_h2").agg(F.any_value(F.struct(*[f"`{c}`" for c in names], *others)).alias("r"))
    return picked.select(*[F.col("r")[c].alias(c) for c in [*names, *others]])


def except_all(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that ``a`` has more often than ``b``, once each, and how many times more (``copies``)."""
    names = _columns(a, b, columns)
    counts = row_counts(a, b, names).filter(F.col("n_old") > F.col("n_new"))
    return _fetched(a, names, counts.select("_h1", "_h2", (F.col("n_old") - F.col("n_new")).alias("copies")))


def intersect_all(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that both have, once each, as many times as the side that has them more rarely (``copies``)."""
    names = _columns(a, b, columns)
    counts = row_counts(a, b, names).filter((F.col("n_old") > 0) & (F.col("n_new") > 0))
    return _fetched(a, names, counts.select("_h1", "_h2", F.least("n_old", "n_new").alias("copies")))


def expand(counted: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as many times as ``copies`` says."""
    rest = [f"`{c}`" for c in counted.columns if c != copies]
    return counted.select(*rest, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*rest)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None,
                  materialize: bool = True) -> DataFrame:
    """What changed from ``old`` to ``new``: ``change``, ``copies`` and the compared columns.

    Without ``keys`` every row is ``added`` or ``removed``.  With them, rows of a key that has both added and removed
    rows are a change of that key: the removed ones are ``before`` and the added ones ``after``.  No order among the
    rows of a key is needed, and keys compare NULL-safely.
    """
    names = _columns(old, new, columns)
    if lacking := [c for c in keys if c not in names]:
        raise ValueError(f"the keys {lacking} are not among the compared columns")
    counts = row_counts(old, new, names).filter(F.col("n_old") != F.col("n_new"))
    if materialize:  # read three times below, and its size decides the joins
        from longstats.session import materialize as write_back
        counts = write_back(counts, "snapshot-counts")
    gap = F.col("n_new") - F.col("n_old")
    more = _fetched(new, names, counts.filter(gap > 0).select("_h1", "_h2", gap.alias("copies")), materialize)
    less = _fetched(old, names, counts.filter(gap < 0).select("_h1", "_h2", (-gap).alias("copies")), materialize)
    diff = more.withColumn("change", F.lit(ADDED)).unionByName(less.withColumn("change", F.lit(REMOVED)))
    out = ["change", "copies", *[f"`{c}`" for c in names]]
    if not keys:
        return diff.select(*out)
    sides = (diff.groupBy(*[f"`{c}`" for c in keys])
             .agg(F.bool_or(F.col("change") == ADDED).alias("_in"), F.bool_or(F.col("change") == REMOVED).alias("_out"))
             .filter(F.col("_in") & F.col("_out")).select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], F.lit(True).alias("_both")))
    same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"s._k{i}")) for i, c in enumerate(keys)]
    told = diff.alias("d").join(sides.alias("s"), same, "left")
    change = (F.when(F.col("_both").isNull(), F.col("change"))
              .when(F.col("change") == ADDED, AFTER).otherwise(BEFORE))
    return told.withColumn("change", change).select(*out)


def snapshot_summary(old: DataFrame, new: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the old and the new load, kept, added and removed, per group: counts alone, no row is fetched."""
    counts = row_counts(old, new, columns, by)
    kept = F.least("n_old", "n_new")
    return counts.groupBy(*by).agg(
        F.sum("n_old").alias("old_rows"), F.sum("n_new").alias("new_rows"), F.sum(kept).alias("kept"),
        F.sum(F.col("n_new") - kept).alias("added"), F.sum(F.col("n_old") - kept).alias("removed"))


def changed_groups(old: DataFrame, new: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The groups whose rows differ in any way: what a reload of parts has to replace."""
    return snapshot_summary(old, new, by, columns).filter((F.col("added") > 0) | (F.col("removed") > 0)).select(*by)
