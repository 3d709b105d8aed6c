"""Benchmark the cleaning job and its headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and
prints one JSON line.  Every query result is fully computed with the ``noop``
sink (no driver collection).  ``value`` is the wall time of the reference's
clean-script scope: the import of escaped gz text drops into a laid-out table,
the materialised roll-up (``clean_job``, built fresh), the four Parquet tables
(counties, states, nation, tidy) and the sharded export.  Every other headline
query over the job is timed too (``queries``; their sum with the script is
``all_headline_steps_sec``), as are one-pass vs three-pass roll-ups from the
same core table.
Before timing, the same pipeline runs once on sf0.01 to warm the JVM (JIT,
generated code); that time is reported as ``warmup_sec``.

With $BENCH_COPIES above 1 only the clean script runs, on that many copies of the rows (counties of their own).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from longstats.operators.levels import clean_levels, clean_levels_per_level  # noqa: E402
from longstats.operators.residual import residual_backfill, tidy_table  # noqa: E402
from longstats.operators.scope import core_scope  # noqa: E402
from longstats.plans import catalog  # noqa: E402
from longstats.plans.queries import MIN_YEAR, QUERIES  # noqa: E402
from longstats.session import build_session, scratch_path  # noqa: E402
from longstats.schemas import LONG_SCHEMA  # noqa: E402
from longstats.sources.export import export_delimited  # noqa: E402
from longstats.plans.job import LEVEL_CLUSTER, TIDY_CLUSTER  # noqa: E402
from longstats.sources.layout import load_table, write_table  # noqa: E402

# what the reference's script does: import the text drops, clean, write the four tables, export
CLEAN_SCRIPT = ["load_tsv_to_table", "clean_job", "write_known_county", "write_clean_state", "write_clean_national",
                "write_tidy", "export_tsv"]
HEADLINE = ["residual_left", "tidy_table", "yield_trend", "yield_trend_converted", "reconcile_levels",
            "source_stat_pivot", "state_profile", "partition_total", "grand_total"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def more_counties(long, copies: int):
    """The long rows ``copies`` times, the county rows of each copy with county codes of their own."""
    if copies == 1:
        return long
    code = F.lpad((F.col("county_code").cast("int") + F.col("_copy") * 5).cast("string"), 3, "0")
    return (long.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .withColumn("county_code", code).select(*long.columns))


def script_at_volume(spark, sf_dir: str, copies: int) -> None:
    """BENCH_COPIES: the clean script alone on many copies of the rows, one JSON line (no warm-up, no headline queries)."""
    drops, out = scratch_path(spark, "volume-drops"), scratch_path(spark, "volume-out")
    export_delimited(more_counties(catalog.long_table(spark, sf_dir), copies), drops)
    q: dict[str, float] = {}
    q["load_tsv_to_table"] = timed(lambda: load_table(spark, drops, f"{out}/raw", LONG_SCHEMA))
    raw = spark.read.parquet(f"{out}/raw").select(*LONG_SCHEMA.fieldNames())
    jobs = []
    q["clean_job"] = timed(lambda: jobs.append(catalog.build_clean_job(core_scope(raw, min_year=MIN_YEAR))))
    for name, cluster in LEVEL_CLUSTER.items():
        q[f"write_{name}"] = timed(lambda n=name, c=cluster: write_table(getattr(jobs[0].levels, n), f"{out}/{n}", cluster_by=c))
    q["write_tidy"] = timed(lambda: write_table(jobs[0].tidy, f"{out}/clean_county", cluster_by=TIDY_CLUSTER))
    tidy = spark.read.parquet(f"{out}/clean_county").select(*jobs[0].tidy.columns)
    q["export_tsv"] = timed(lambda: export_delimited(tidy, f"{out}/export"))
    rows, script = raw.count(), round(sum(q.values()), 3)
    print(json.dumps({"metric": "clean_script_at_volume", "value": script, "unit": "sec", "queries": q, "rows": rows,
                      "tidy_rows": tidy.count(), "rows_per_sec": round(rows / script, 1), "copies": copies}))


def pipeline(spark, sf_dir: str) -> dict[str, float]:
    """Import, clean, write and export as the job does, then the headline queries; per-step seconds.

    The text drops are made from the derived long view first, untimed.
    """
    long = catalog.long_table(spark, sf_dir)
    drops, out = scratch_path(spark, "bench-drops"), scratch_path(spark, "bench-out")
    export_delimited(long, drops)
    q: dict[str, float] = {}
    q["load_tsv_to_table"] = timed(lambda: load_table(spark, drops, f"{out}/raw", LONG_SCHEMA))
    raw = spark.read.parquet(f"{out}/raw").select(*LONG_SCHEMA.fieldNames())
    jobs = []
    # the roll-up is built and written here, for all three levels
    q["clean_job"] = timed(lambda: jobs.append(catalog.build_clean_job(core_scope(raw, min_year=MIN_YEAR))))
    job = jobs[0]
    q["write_known_county"] = timed(lambda: write_table(job.levels.known_county, f"{out}/known_county",
                                                        cluster_by=("state_name", "commodity_desc")))
    q["write_clean_state"] = timed(lambda: write_table(job.levels.clean_state, f"{out}/clean_state",
                                                       cluster_by=("state_name", "commodity_desc")))
    q["write_clean_national"] = timed(lambda: write_table(job.levels.clean_national, f"{out}/clean_national",
                                                          cluster_by=("commodity_desc",)))
    q["write_tidy"] = timed(lambda: write_table(job.tidy, f"{out}/clean_county", cluster_by=TIDY_CLUSTER))
    tidy = spark.read.parquet(f"{out}/clean_county").select(*job.tidy.columns)
    q["export_tsv"] = timed(lambda: export_delimited(tidy, f"{out}/export"))
    catalog.clean_job(spark, sf_dir, MIN_YEAR)  # what the headline queries read, untimed
    for name in HEADLINE:
        q[name] = timed(lambda n=name: run(QUERIES[n](spark, sf_dir)))
    return q


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
    spark = build_session()
    if int(os.environ.get("BENCH_COPIES", "1")) > 1:
        script_at_volume(spark, sf_dir, int(os.environ["BENCH_COPIES"]))
        spark.stop()
        return
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    # JVM start, JIT and code generation: the same pipeline once on the smallest
    # scale factor, reported separately.
    warmup = round(sum(pipeline(spark, warm_dir).values()), 3) if os.path.isdir(warm_dir) else 0.0
    # the measured run lands and builds from scratch even when it uses the warm-up folder
    catalog.forget(spark, warm_dir)
    catalog.forget(spark, sf_dir)

    q = pipeline(spark, sf_dir)
    script = round(sum(q[k] for k in CLEAN_SCRIPT), 3)
    total = round(sum(q.values()), 3)
    long = catalog.long_table(spark, sf_dir)
    rows = long.count()

    core = core_scope(long, min_year=MIN_YEAR)

    def tidy_with(levels):
        unspecified = residual_backfill(levels.clean_state, levels.known_county, how="left")
        run(tidy_table(levels.known_county, unspecified))

    extra = {
        "tidy_one_pass_fresh": timed(lambda: tidy_with(clean_levels(core, materialize=True))),
        "tidy_three_pass_fresh": timed(lambda: tidy_with(clean_levels_per_level(core))),
        "tidy_one_pass_unmaterialized": timed(lambda: tidy_with(clean_levels(core, materialize=False))),
    }
    print(json.dumps({
        "metric": "clean_script_end_to_end", "value": script, "unit": "sec",
        "queries": {**q, **extra}, "sf": sf, "rows": rows,
        "rows_per_sec": round(rows / script, 1) if script else None,
        "all_headline_steps_sec": total,
        "warmup_sec": warmup, "warmup_dir": warm_dir, "cpus": os.environ.get("BENCH_CPUS", "8"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
