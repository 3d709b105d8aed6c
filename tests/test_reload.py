"""Reload of some years: equal to a full reload, all or nothing, other years' files untouched."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from longstats.plans import catalog
from longstats.plans.job import refresh_job, run_job
from longstats.schemas import LONG_COLUMNS, LONG_SCHEMA, RAW_COLUMNS
from longstats.session import scratch_path
from longstats.sources import commit_partitions, export_delimited, load_table, reload_years, replace_partitions, table_files, write_table

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _files(spark, target):
    return {r["path"]: r["year"] for r in table_files(spark, target).collect()}


def _drop(df, name="drop"):
    path = scratch_path(df.sparkSession, name)
    export_delimited(df, path)
    return path


@pytest.fixture()
def table(spark):
    """The long table with a wrong 1998 (other values, some rows lacking)."""
    long = catalog.long_table(spark, SF)
    old = long.filter((F.col("year") != 1998) | (F.col("state_name") != "NATION_3")).withColumn(
        "value", F.when(F.col("year") == 1998, F.lit("(D)")).otherwise(F.col("value")))
    target = scratch_path(spark, "reload-target")
    write_table(old, target)
    return long, target


def test_equals_a_full_reload_and_leaves_other_years_alone(spark, table):
    long, target = table
    before = _files(spark, target)
    got = reload_years(spark, _drop(long.filter("year = 1998")), target, LONG_SCHEMA, [1998])
    full = load_table(spark, _drop(long), scratch_path(spark, "full"), LONG_SCHEMA)
    assert got.columns == LONG_COLUMNS and _rows(got) == _rows(full)
    after = _files(spark, target)
    assert {p for p, y in before.items() if y != "1998"} == {p for p, y in after.items() if y != "1998"}
    assert not {p for p, y in before.items() if y == "1998"} & set(after)
    # a rerun gives the same table
    assert _rows(reload_years(spark, _drop(long.filter("year = 1998")), target, LONG_SCHEMA, [1998])) == _rows(full)


def test_a_bad_drop_changes_nothing(spark, table):
    long, target = table
    before, rows = _files(spark, target), _rows(spark.read.parquet(target))
    bad = _drop(long.filter("year = 1998"))
    extra = scratch_path(spark, "bad").replace("file:", "")
    os.makedirs(extra)
    with gzip.open(f"{extra}/x.gz", "wt") as f:
        f.write("header\nonly\ttwo fields\n")
    with pytest.raises(Exception, match="malformed"):
        reload_years(spark, [bad, extra], target, LONG_SCHEMA, [1998])
    with pytest.raises(ValueError, match="1997"):
        reload_years(spark, _drop(long.filter("year in (1997, 1998)")), target, LONG_SCHEMA, [1998])
    with pytest.raises(ValueError, match="columns"):
        replace_partitions(long.drop("value").filter("year = 1998"), target, [1998])
    assert _files(spark, target) == before and _rows(spark.read.parquet(target)) == rows


def test_an_aborted_commit_changes_nothing(spark, table):
    long, target = table
    before, rows = _files(spark, target), _rows(spark.read.parquet(target))
    # the last rows of the sorted partition fail, when files of the year are half written
    failing = long.filter("year in (1997, 1998)").withColumn("value", F.when(
        (F.col("year") == 1998) & (F.col("commodity_desc") == "WHEAT"), F.raise_error(F.lit("disk gone"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="disk gone"):
        commit_partitions(failing, target)
    assert _files(spark, target) == before and _rows(spark.read.parquet(target)) == rows


def test_withdrawn_and_new_years(spark, table):
    long, target = table
    new = long.filter("year = 1997").withColumn("year", F.lit(2030))
    done = replace_partitions(long.filter("year = 1997").unionByName(new), target, [1996, 1997, 2030, 2031])
    assert done.replaced == (1997, 2030) and done.withdrawn == (1996,)
    years = {r[0] for r in spark.read.parquet(target).select("year").distinct().collect()}
    assert 1996 not in years and 2030 in years and 1998 in years
    # nothing at all for a year: it goes
    done = replace_partitions(long.limit(0), target, [2030])
    assert done.replaced == () and done.withdrawn == (2030,)


def test_first_load(spark):
    long = catalog.long_table(spark, SF)
    target = scratch_path(spark, "first")
    done = replace_partitions(long.filter("year < 1998"), target, [1995, 1996, 1997])
    assert done.replaced == (1995, 1996, 1997) and done.withdrawn == ()
    assert spark.read.parquet(target).count() == long.filter("year < 1998").count()


# ---------------------------------------------------------------- the job

def _raw(spark, long):
    """The long rows as drops of the raw file."""
    missing = {c.lower() for c in RAW_COLUMNS} - set(LONG_COLUMNS)
    wide = long.select("*", *[F.lit(None).cast("string").alias(c) for c in sorted(missing)])
    return wide.select(*[c.lower() for c in RAW_COLUMNS])


def _tables(spark, out):
    return [_rows(spark.read.parquet(p)) for p in (out.raw_table, out.known_county, out.clean_state, out.clean_national,
                                                  out.clean_county, out.redundant_totals, out.known_classes)]


def _refreshed(spark, old, new, years):
    """(refreshed job, tables after it, tables of the whole job on the new rows)."""
    output = scratch_path(spark, "refreshed")
    run_job(spark, _drop(_raw(spark, old)), output, min_year=1996)
    before = _files(spark, f"{output}/clean_county")
    done = refresh_job(spark, _drop(_raw(spark, new.filter(F.col("year").isin(years)))), output, years, min_year=1996)
    whole = run_job(spark, _drop(_raw(spark, new)), scratch_path(spark, "whole"), min_year=1996)
    after = _files(spark, f"{output}/clean_county")
    kept = {p for p, y in before.items() if y not in map(str, years)}
    return done, _tables(spark, done.outputs), _tables(spark, whole), kept <= set(after), spark.read.text(done.outputs.export).count()


def test_refreshed_job_equals_the_whole_job(spark):
    new = catalog.long_table(spark, SF)
    old = new.withColumn("value", F.when(F.col("year") == 1998, F.lit("7")).otherwise(F.col("value")))
    done, got, want, untouched, exported = _refreshed(spark, old, new, [1998])
    assert got == want and not done.rebuilt and untouched
    assert exported >= len(got[4])


def test_a_changed_class_list_rebuilds_all_years(spark):
    new = catalog.long_table(spark, SF)
    # before, cotton reported one class only, and 1999 alone adds the others
    old = new.filter((F.col("commodity_desc") != "COTTON") | (F.col("class_desc") == "ALL CLASSES"))
    new = old.unionByName(new.filter((F.col("commodity_desc") == "COTTON") & (F.col("class_desc") != "ALL CLASSES") & (F.col("year") == 1999)))
    done, got, want, _, _ = _refreshed(spark, old, new, [1999])
    assert got == want and done.rebuilt
