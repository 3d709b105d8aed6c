"""Reload of a part of a laid-out table: a drop replaces the years it is for, and nothing else is touched.

The drop is parsed, checked and laid out in a staging folder first.  Whatever
can fail there (a malformed record, a row of a year that the drop isn't for)
fails before the table is touched.  The staged rows then replace their
partitions by a dynamic partition overwrite: its tasks write beside the table,
and only when all of them are done do the new folders take the old ones' place,
so an aborted write leaves the table as it was.  Folders of other years are
neither read nor written and keep their files.

A year that the drop is for but has no row of has been withdrawn: its folder is
removed.  Rerunning a reload gives the same table, so a run that broke off is
simply run again.  The staged copy is a second write of the touched years, the
price of never touching the table on a bad drop.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from longstats.session import remove_path, scratch_path
from longstats.sources.layout import DEFAULT_CLUSTER, write_table


@dataclass(frozen=True)
class Reloaded:
    """What a reload did: partition values replaced by new rows, and those left without any."""

    replaced: tuple
    withdrawn: tuple


def table_files(spark: SparkSession, target: str, partition_by: str = "year") -> DataFrame:
    """``path`` and partition value of every file of a laid-out table, from its listing."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(target))
    return files.select("path", F.regexp_extract("path", f"/{partition_by}=([^/]+)/", 1).alias(partition_by))


def _partitions(spark: SparkSession, target: str, by: str, schema: StructType) -> list:
    """The partition values of a laid-out table, from its listing (no file is opened)."""
    kind = schema[by].dataType
    return sorted(r[0] for r in table_files(spark, target, by).select(F.col(by).cast(kind)).distinct().collect())


def _columns(spark: SparkSession, target: str) -> list[str] | None:
    """The columns of the table at ``target``, or None if there is none yet."""
    try:
        return spark.read.parquet(target).columns
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commit_partitions(staged: DataFrame, target: str, partition_by: str = "year",
                      cluster_by: Sequence[str] = DEFAULT_CLUSTER) -> None:
    """Replace in the table at ``target`` the partitions that ``staged`` has rows of (all of them, or none)."""
    keys = [c for c in (partition_by, *cluster_by) if c in staged.columns]
    (staged.hint("rebalance", partition_by).sortWithinPartitions(*keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(target))


def replace_partitions(rows: DataFrame, target: str, values: Iterable, partition_by: str = "year",
                       cluster_by: Sequence[str] = DEFAULT_CLUSTER, stage_root: str | None = None) -> Reloaded:
    """Replace the partitions ``values`` of the table at ``target`` by ``rows``.

    Raises, and leaves the table alone, if ``rows`` can't be computed, lack a column of the table or
    have a row of another partition.  Without a table at ``target`` this is its first load.
    """
    spark = rows.sparkSession
    wanted = sorted(set(values))
    columns = _columns(spark, target)
    if columns is not None and sorted(columns) != sorted(rows.columns):
        raise ValueError(f"the table has the columns {sorted(columns)}, the rows {sorted(rows.columns)}")
    before = _partitions(spark, target, partition_by, rows.schema) if columns else []
    path = f"{stage_root.rstrip('/')}/reload" if stage_root else scratch_path(spark, "reload")
    try:
        write_table(rows, path, (partition_by,), cluster_by)
        there = _partitions(spark, path, partition_by, rows.schema)
        if strange := [v for v in there if v not in wanted]:
            raise ValueError(f"rows of {partition_by} {strange} in a reload of {wanted}")
        if there:
            commit_partitions(spark.read.schema(rows.schema).parquet(path), target, partition_by, cluster_by)
        gone = [v for v in before if v in wanted and v not in there]
        for value in gone:
            remove_path(spark, f"{target.rstrip('/')}/{partition_by}={value}")
    finally:
        remove_path(spark, path)
    spark.catalog.refreshByPath(target)
    return Reloaded(replaced=tuple(there), withdrawn=tuple(gone))


def reload_years(spark: SparkSession, path: str | Sequence[str], target: str, schema: StructType, years: Iterable[int],
                 escaped: bool = True, cluster_by: Sequence[str] = DEFAULT_CLUSTER, **read_options) -> DataFrame:
    """Load delimited drops of ``years`` into the table at ``target``; returns the whole table.

    The result equals a truncate-and-load of all years with these years' rows from the drops.
    """
    from longstats.sources.delimited import read_delimited, read_escaped
    reader = read_escaped if escaped else read_delimited
    replace_partitions(reader(spark, path, schema, **read_options), target, years, "year", cluster_by)
    return spark.read.parquet(target).select(*[f.name for f in schema.fields])
