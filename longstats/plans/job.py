"""The cleaning job as one runnable unit.

    python -m longstats.plans.job --input s3://bucket/drops/ --output s3://bucket/clean/ [--min-year 1990]

    python -m longstats.plans.job --input s3://bucket/drops-2012/ --output s3://bucket/clean/ --years 2012

Steps: load the raw delimited drops under the 39-column schema into a laid-out
Parquet table (truncate-and-load), scope the core rows, build the level tables
with one roll-up pass, backfill the residual counties, write the level tables
and the tidy county table as Parquet, and export the tidy table as escaped,
gzipped, tab-separated text with a header in every file.  Intermediate tables
are staged under the output folder and removed at the end.

With ``--years`` the input holds those years only: they are replaced in the raw table, and only their partitions of
the level tables and the tidy table are built again, unless the reload changes a class list (a commodity's classes in
any year decide which rows count in every year); then the tables are rebuilt from the raw table.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longstats.operators.levels import clean_levels, known_classes, varied_commodities
from longstats.operators.residual import reconcile_gate, reconcile_levels, residual_backfill, tidy_table
from longstats.operators.scope import DEFAULT_MIN_YEAR, core_scope
from longstats.plans.catalog import CleanJob, build_clean_job
from longstats.schemas import RAW_SCHEMA
from longstats.sources.export import export_delimited
from longstats.session import materialize, remove_path
from longstats.sources.layout import load_table, write_table
from longstats.sources.reload import reload_years, replace_partitions

#: Clustering of the tidy table inside its years.
TIDY_CLUSTER = ("fips_county_code",)


#: Clustering of the level tables inside their years.
LEVEL_CLUSTER = {"known_county": ("state_name", "commodity_desc"), "clean_state": ("state_name", "commodity_desc"),
                 "clean_national": ("commodity_desc",)}


@dataclass
class JobOutputs:
    raw_table: str
    known_county: str
    clean_state: str
    clean_national: str
    clean_county: str
    export: str
    redundant_totals: str
    known_classes: str
    reconciliation: str


def _outputs(output: str) -> JobOutputs:
    out = output.rstrip("/")
    return JobOutputs(raw_table=f"{out}/raw", known_county=f"{out}/known_county",
                      clean_state=f"{out}/clean_state", clean_national=f"{out}/clean_national",
                      clean_county=f"{out}/clean_county", export=f"{out}/export/clean_county",
                      redundant_totals=f"{out}/lists/redundant_totals", known_classes=f"{out}/lists/known_classes",
                      reconciliation=f"{out}/reconciliation")


def _write_tables(spark: SparkSession, job: CleanJob, paths: JobOutputs) -> None:
    for name, cluster in LEVEL_CLUSTER.items():
        write_table(getattr(job.levels, name), getattr(paths, name), cluster_by=cluster)
    write_table(job.tidy, paths.clean_county, cluster_by=TIDY_CLUSTER)
    job.levels.redundant.write.mode("overwrite").parquet(paths.redundant_totals)
    job.levels.known.write.mode("overwrite").parquet(paths.known_classes)


def _export(spark: SparkSession, paths: JobOutputs, columns: list[str]) -> None:
    export_delimited(spark.read.parquet(paths.clean_county).select(*columns), paths.export)


class ReconciliationFailed(ValueError):
    """The levels differ by more than the tolerance; the failing figures are in the job's reconciliation table."""


def _reconciled(paths: JobOutputs, tidy: DataFrame, national: DataFrame, tolerance: float) -> None:
    """Write the figures of counties and nation that differ by more than the tolerance, and raise if there are any."""
    keys, measures = ["year", "commodity_name", "commodity_class_variety"], ["area_planted", "area_harvested", "crop_production"]
    names = ("county", "national")
    spark = tidy.sparkSession
    # a table without rows has no file to read a schema from
    report = reconcile_levels(spark.read.schema(tidy.schema).parquet(paths.clean_county),
                              spark.read.schema(national.schema).parquet(paths.clean_national), keys, measures, names)
    reconcile_gate(report, keys, measures, names, tolerance).write.mode("overwrite").parquet(paths.reconciliation)
    if failing := spark.read.parquet(paths.reconciliation).count():
        raise ReconciliationFailed(f"{failing} figures differ by more than {tolerance:.3g} of the national one: {paths.reconciliation}")


def run_job(spark: SparkSession, input_path: str, output: str, min_year: int = DEFAULT_MIN_YEAR,
            escaped: bool = True, tolerance: float | None = None) -> JobOutputs:
    """Run the whole job; returns the output locations.

    With ``tolerance`` the counties' totals must be that near to the nation's (as a share of it): else the failing
    figures are written, nothing is exported and ``ReconciliationFailed`` is raised.
    """
    paths, staging = _outputs(output), f"{output.rstrip('/')}/_stage"
    try:
        raw = load_table(spark, input_path, paths.raw_table, RAW_SCHEMA, escaped=escaped)
        job = build_clean_job(core_scope(raw, min_year=min_year), root=staging)
        _write_tables(spark, job, paths)
        if tolerance is not None:
            _reconciled(paths, job.tidy, job.levels.clean_national, tolerance)
        _export(spark, paths, job.tidy.columns)
    finally:
        remove_path(spark, staging)
    return paths


def _same_list(a: DataFrame, b: DataFrame) -> bool:
    """Whether two class lists hold the same pairs (lists of distinct pairs; both stay distributed)."""
    on = ["commodity_desc", "class_desc"]
    a, b = a.select(*on), b.select(*on)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@dataclass
class Refreshed:
    outputs: JobOutputs
    #: Whether a class list changed, so that every year was built again.
    rebuilt: bool


def refresh_job(spark: SparkSession, input_path: str, output: str, years: Iterable[int],
                min_year: int = DEFAULT_MIN_YEAR, escaped: bool = True, tolerance: float | None = None) -> Refreshed:
    """Bring the tables of an earlier ``run_job`` up to date with drops of some ``years``.

    The result equals ``run_job`` on all drops.  Roll-up and residual are computed per year; what ties the years
    together is the two class lists.  The list of redundant totals is taken again over all years (a scan of three
    columns), the known classes are those of the touched years and of the stored table's other years.  While both
    equal the stored lists, only the touched years are read and written.
    """
    years = sorted(set(years))
    paths, staging = _outputs(output), f"{output.rstrip('/')}/_stage"
    touched = F.col("year").isin(years)
    try:
        raw = reload_years(spark, input_path, paths.raw_table, RAW_SCHEMA, years, escaped=escaped)
        core = core_scope(raw, min_year=min_year)
        redundant = materialize(varied_commodities(core), "redundant_totals", root=staging)
        others = known_classes(spark.read.schema("commodity_desc string, class_desc string, year int").parquet(paths.known_county)
                               .filter(~touched))
        levels = clean_levels(core.filter(touched), root=staging, redundant=redundant, known_elsewhere=others)
        rebuild = not (_same_list(redundant, spark.read.parquet(paths.redundant_totals))
                       and _same_list(levels.known, spark.read.parquet(paths.known_classes)))
        if rebuild:
            job = build_clean_job(core, root=staging)
            tidy = job.tidy
            _write_tables(spark, job, paths)
        else:
            tidy = tidy_table(levels.known_county, residual_backfill(levels.clean_state, levels.known_county))
            for name, cluster in LEVEL_CLUSTER.items():
                replace_partitions(getattr(levels, name), getattr(paths, name), years, cluster_by=cluster, stage_root=f"{staging}/{name}")
            replace_partitions(tidy, paths.clean_county, years, cluster_by=TIDY_CLUSTER, stage_root=f"{staging}/tidy")
        if tolerance is not None:
            _reconciled(paths, tidy, levels.clean_national, tolerance)
        _export(spark, paths, tidy.columns)
    finally:
        remove_path(spark, staging)
    return Refreshed(paths, rebuild)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="raw delimited drops (file, folder or glob)")
    parser.add_argument("--output", required=True, help="output folder")
    parser.add_argument("--min-year", type=int, default=DEFAULT_MIN_YEAR)
    parser.add_argument("--years", type=int, nargs="+", help="the input holds these years only: replace them in the output")
    parser.add_argument("--tolerance", type=float, help="largest difference of county and national totals, as a share")
    parser.add_argument("--unescaped", action="store_true", help="input has no backslash escapes (CSV path)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("longstats-clean-job").getOrCreate()
    if args.years:
        print(refresh_job(spark, args.input, args.output, args.years, args.min_year, not args.unescaped, args.tolerance))
    else:
        print(run_job(spark, args.input, args.output, args.min_year, not args.unescaped, args.tolerance))


if __name__ == "__main__":
    main()
