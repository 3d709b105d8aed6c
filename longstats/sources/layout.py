"""Laid-out Parquet tables: partitioned by year, clustered within files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_CLUSTER = ("agg_level_desc", "state_name", "commodity_desc")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",),
                cluster_by: Sequence[str] = DEFAULT_CLUSTER, mode: str = "overwrite",
                repartition: bool = True) -> None:
    """Write ``df`` as Parquet, ``partitionBy(partition_by)``, rows sorted by
    (partition keys, ``cluster_by``) inside each file.

    One shuffle, a rebalance on the partition keys: tasks are sized by
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, small ones are merged
    and a hot year is split, so file count follows the data and not a setting
    for all sizes.  The sort keeps row-group min/max statistics tight, so
    level/state/commodity filters skip row groups and year filters prune whole
    directories.

    ``repartition=False`` keeps the input partitioning, for input that is
    already hash-partitioned into balanced partitions by an upstream shuffle:
    each task then still writes at most one file per partition value.
    """
    keys = [c for c in (*partition_by, *cluster_by) if c in df.columns]
    parts = [c for c in partition_by if c in df.columns]
    out = df.hint("rebalance", *parts) if repartition else df
    if keys:
        out = out.sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_table(spark: SparkSession, path: str, target: str, schema: StructType, escaped: bool = True,
               partition_by: Sequence[str] = ("year",), cluster_by: Sequence[str] = DEFAULT_CLUSTER,
               **read_options) -> DataFrame:
    """Truncate-and-load: read delimited text under ``schema`` and replace the
    Parquet table at ``target`` with it (idempotent: a rerun gives the same
    table).  Returns the loaded table."""
    from longstats.sources.delimited import read_delimited, read_escaped
    reader = read_escaped if escaped else read_delimited
    write_table(reader(spark, path, schema, **read_options), target, partition_by, cluster_by, mode="overwrite")
    return spark.read.parquet(target).select(*[f.name for f in schema.fields])
