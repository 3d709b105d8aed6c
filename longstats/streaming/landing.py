"""Incremental landing of delimited drops with Structured Streaming.

The reference has no streaming; its load is "put a file on the stage, then
bulk-load it".  The Spark form of loading whatever files have landed in a
folder is a file-source stream with an ``availableNow`` trigger: each run
loads only files not yet seen (tracked in the checkpoint), writes them to a
Parquet table through the exactly-once file sink, and stops.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from longstats.functions.text import NULL_TOKENS, normalise_nulls
from longstats.session import scratch_path


def drop_stream(spark: SparkSession, source_dir: str, schema: StructType, sep: str = "\t", header: bool = True,
                trim: bool = True, null_tokens: Iterable[str] = NULL_TOKENS,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """The rows of delimited files as they land in ``source_dir``, parsed as ``read_delimited`` does."""
    reader = (spark.readStream.schema(schema)
              .option("sep", sep).option("header", header).option("quote", "")
              .option("mode", "FAILFAST").option("nullValue", "")
              .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalise_nulls(reader.csv(source_dir), null_tokens)


def land_stream(spark: SparkSession, source_dir: str, schema: StructType, target: str,
                checkpoint: str | None = None, sep: str = "\t", header: bool = True, trim: bool = True,
                null_tokens: Iterable[str] = NULL_TOKENS, partition_by: Sequence[str] = ("year",),
                max_files_per_trigger: int | None = None, wait: bool = True) -> StreamingQuery:
    """Load new delimited files of ``source_dir`` into the Parquet table ``target``.

    Same parsing rules as ``read_delimited`` (quoting off, FAILFAST, multi-token
    NULLs).  ``checkpoint`` defaults to a fresh folder under the session's
    shared checkpoint directory; pass a stable one to make reruns incremental.
    """
    rows = drop_stream(spark, source_dir, schema, sep, header, trim, null_tokens, max_files_per_trigger)
    writer = (rows.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "landing-checkpoint"))
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(target)
    if wait:
        query.awaitTermination()
    return query
