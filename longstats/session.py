"""Session helpers: a tuned local session for tests/bench and shared scratch paths.

Intermediate tables are written under the folder the cluster names in
``spark.checkpoint.dir`` (read from the session).  A private folder is only
created when that setting is absent and the master is local; on a cluster
without the setting an error says so, because executors don't share local disks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "longstats",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library is tuned for.

    AQE stays on: it coalesces small shuffle partitions, turns joins whose
    measured build side is small into broadcast joins, and splits skewed
    partitions of sort-merge joins.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a
        # whole-stage-codegen method above that runs interpreted, so fall back
        # to per-operator code instead (the value Spark documents for HotSpot)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session: ``spark.checkpoint.dir``, else the context's checkpoint directory.

    When neither is set, a local master gets a private folder, registered as the context's checkpoint directory;
    any other master (a cluster, local-cluster included) raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="longstats-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, unique per application and call."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark).rstrip('/')}/longstats/{app}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through its own file system; False if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder (or ``root``) and read it back.

    Cuts lineage (a lost executor re-reads files instead of re-running the
    plan) and, unlike an RDD checkpoint, keeps column pruning and filter
    pushdown for every later reader, and tells the planner its size.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}" if root else scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)
