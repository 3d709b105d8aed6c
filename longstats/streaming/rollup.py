"""Roll-up kept up to date by a stream of drops.

Drops are read as they land.  A row that comes again (the same identity) within
the watermark is dropped, so a drop that is delivered twice counts once.  The
totals per group are state; after every micro-batch the groups that changed are
merged into a Parquet table, each with its whole total.  A merge sets groups and
adds nothing, so a micro-batch that is run again after a failure leaves the same
table, and it replaces the touched periods' partitions only (staged commit of
``replace_partitions``).

What is kept of a row for that is a 128-bit hash of its identity and a time, not its
columns, and the state lies in RocksDB (on the executors' disks, with a bounded
cache), not on the heap: it grows with the rows within the watermark, by some tens
of bytes each.  At 2^40 such rows the chance that any two that differ have equal
hashes is below 2^-48.  A checkpoint of an older form of this state can't be resumed.

Rows older than the watermark can't be told from repeated ones any more, so they
are left out; ``StreamReport`` counts them, as it counts the repeated ones.  The
report covers the run that returns it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from longstats.functions.text import NULL_TOKENS
from longstats.operators.snapshot import row_hash
from longstats.sources.reload import replace_partitions
from longstats.streaming.landing import drop_stream

#: Progress reports kept of one run; one per micro-batch.
KEPT_REPORTS = 100_000

#: Settings of a run: all its reports are kept, and its state lies in RocksDB with bounded memory.
RUN_SETTINGS = {
    "spark.sql.streaming.numRecentProgressUpdates": str(KEPT_REPORTS),
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # no look-up before every write, just to count the state's rows
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@dataclass(frozen=True)
class StreamReport:
    """Rows read, left out as too late, and left out as repeated."""

    input_rows: int
    late_rows: int
    repeated_rows: int


def merge_groups(changed: DataFrame, target: str, keys: Sequence[str], period: str) -> None:
    """Set the groups of ``changed`` in the table at ``target``; other groups of the touched periods stay."""
    from pyspark.errors import AnalysisException
    spark = changed.sparkSession
    periods = [r[0] for r in changed.select(period).distinct().collect()]  # one per touched period
    if not periods:
        return
    try:
        old = spark.read.schema(changed.schema).parquet(target).filter(F.col(period).isin(periods))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        old = changed.limit(0)
    new = changed.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    kept = old.alias("o").join(new, same, "left_anti")
    replace_partitions(kept.select(*changed.columns).unionByName(changed), target, periods, period, tuple(k for k in keys if k != period))


def _reported(query) -> StreamReport:
    read = late = repeated = 0
    for p in query.recentProgress:
        read += p["numInputRows"]
        for state in p["stateOperators"]:
            late += state["numRowsDroppedByWatermark"]
            repeated += int(state["customMetrics"].get("numDroppedDuplicateRows", 0))
    return StreamReport(read, late, repeated)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """The session's settings as ``wanted``, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rollup_stream(spark: SparkSession, source_dir: str, schema: StructType, target: str, checkpoint: str,
                  keys: Sequence[str], totals: dict[str, Column], event_time: Column, delay: str,
                  identity: Sequence[str] | None = None, period: str = "year", sep: str = "\t", header: bool = True,
                  null_tokens: Iterable[str] = NULL_TOKENS, max_files_per_trigger: int | None = None) -> StreamReport:
    """Take in all drops of ``source_dir`` that earlier runs with this ``checkpoint`` haven't; returns what was left out.

    ``keys`` are the groups (``period`` among them), ``totals`` their aggregates by name, ``event_time`` a row's time and
    ``delay`` how far behind the latest one it may be.  ``identity`` are the columns that make a row the same as another
    (all, if not given).
    """
    if period not in keys:
        raise ValueError(f"{period} must be one of the keys")
    rows = drop_stream(spark, source_dir, schema, sep, header, True, null_tokens, max_files_per_trigger)
    h1, h2 = row_hash(list(identity or schema.fieldNames()))
    once = (rows.withColumns({"_time": event_time, "_h1": h1, "_h2": h2}).withWatermark("_time", delay)
            .dropDuplicatesWithinWatermark(["_h1", "_h2"]))
    # the time is a function of the period, so it adds no group; it lets Spark forget periods that are closed
    grouped = once.groupBy("_time", *keys).agg(*[c.alias(n) for n, c in totals.items()])

    def merge(batch: DataFrame, _: int) -> None:
        held = batch.drop("_time").persist()
        try:
            merge_groups(held, target, keys, period)
        finally:
            held.unpersist()

    with _settings(spark, RUN_SETTINGS):
        query = (grouped.writeStream.outputMode("update").foreachBatch(merge)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    return _reported(query)
