"""The whole job on the 39-column raw schema: escaped gzip TSV -> load_table ->
core_scope -> build_clean_job -> tidy table -> export, as in the README."""

import gzip
import os
from decimal import Decimal

from pyspark.sql import functions as F

from longstats.operators import core_scope, yield_trend
from longstats.plans.catalog import build_clean_job
from longstats.schemas import RAW_COLUMNS, RAW_SCHEMA, TIDY_COLUMNS, TIDY_SCHEMA
from longstats.session import scratch_path
from longstats.sources import export_delimited, load_table, read_escaped


def _raw_line(**kv):
    base = {c: "" for c in RAW_COLUMNS}
    base.update({"SOURCE_DESC": "SURVEY", "SECTOR_DESC": "CROPS", "GROUP_DESC": "FIELD CROPS",
                 "PRODN_PRACTICE_DESC": "ALL PRODUCTION PRACTICES", "UTIL_PRACTICE_DESC": "ALL UTILIZATION PRACTICES",
                 "DOMAIN_DESC": "TOTAL", "STATE_FIPS_CODE": "38", "STATE_ALPHA": "ND", "STATE_NAME": "NORTH DAKOTA",
                 "FREQ_DESC": "ANNUAL", "REFERENCE_PERIOD_DESC": "YEAR", "COUNTRY_NAME": "UNITED STATES"})
    base.update({k.upper(): v for k, v in kv.items()})
    return "\t".join(base[c] for c in RAW_COLUMNS)


def _raw_drops(spark):
    wheat = {"COMMODITY_DESC": "WHEAT", "CLASS_DESC": "SPRING, (EXCL DURUM)", "STATISTICCAT_DESC": "AREA HARVESTED",
             "UNIT_DESC": "ACRES", "YEAR": "2019"}
    lines = [
        _raw_line(**wheat, AGG_LEVEL_DESC="COUNTY", COUNTY_CODE="998", COUNTY_NAME="OTHER (COMBINED) COUNTIES",
                  VALUE="433,100"),
        _raw_line(**wheat, AGG_LEVEL_DESC="COUNTY", COUNTY_CODE="005", COUNTY_NAME="BENSON", VALUE="(D)"),
        _raw_line(**wheat, AGG_LEVEL_DESC="STATE", VALUE="5,000,000"),
        _raw_line(**{**wheat, "YEAR": "1989"}, AGG_LEVEL_DESC="STATE", VALUE="1"),            # before min year
        _raw_line(COMMODITY_DESC="FLOWERING PLANTS, POTTED", CLASS_DESC="INDOOR USE, HYDRANGEA",
                  STATISTICCAT_DESC="SALES", UNIT_DESC="POTS", AGG_LEVEL_DESC="STATE", YEAR="2009", VALUE="820"),
    ]
    header = "\t".join(RAW_COLUMNS).replace("CV_PERCENT", "CV_%")
    drops = scratch_path(spark, "raw-drops").replace("file:", "")
    os.makedirs(drops, exist_ok=True)
    with gzip.open(os.path.join(drops, "part-0.txt.gz"), "wt", encoding="utf-8") as fh:
        fh.write(header + "\n" + "\n".join(lines) + "\n")
    return drops


def test_raw_file_to_tidy_table(spark):
    drops = _raw_drops(spark)
    raw = load_table(spark, drops, scratch_path(spark, "raw-table"), RAW_SCHEMA)
    assert raw.count() == 5 and raw.columns == [f.name for f in RAW_SCHEMA.fields]
    job = build_clean_job(core_scope(raw, min_year=1990))
    tidy = job.tidy
    assert tidy.columns == TIDY_COLUMNS
    rows = {r.county_name: r for r in tidy.collect()}
    assert set(rows) == {"Other (Combined) Counties", "Benson", "Unspecified"}
    assert rows["Other (Combined) Counties"].fips_county_code == "38998"
    assert rows["Other (Combined) Counties"].area_harvested == Decimal("433100.000")
    assert rows["Benson"].area_harvested is None                       # (D) parses to NULL
    assert rows["Unspecified"].area_harvested == Decimal("4566900.000")   # state minus known counties
    assert rows["Unspecified"].state_name == "North Dakota"
    assert rows["Unspecified"].commodity_class_variety == "Spring, (Excl Durum)"

    trend = yield_trend(tidy, "Wheat").collect()
    assert [(r.year, r.harvested) for r in trend] == [(2019, Decimal("5000000.000"))]

    out = scratch_path(spark, "tidy-export")
    export_delimited(tidy, out)
    back = read_escaped(spark, out, TIDY_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, tidy.collect()), key=str)
    assert back.filter(F.col("fips_county_code").isNull()).count() == 1


def test_run_job_writes_all_outputs(spark):
    from longstats.plans.job import run_job
    out = run_job(spark, _raw_drops(spark), scratch_path(spark, "job-out"))
    tidy = spark.read.parquet(out.clean_county)
    assert tidy.count() == 3
    assert spark.read.parquet(out.known_county).count() == 2
    assert spark.read.parquet(out.clean_state).count() == 1
    back = read_escaped(spark, out.export, TIDY_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        map(tuple, tidy.select(*TIDY_COLUMNS).collect()), key=str)


def test_run_job_stages_under_its_output_and_cleans_up(spark):
    import os

    from longstats.plans.job import run_job
    target = scratch_path(spark, "job-stage").replace("file:", "")
    run_job(spark, _raw_drops(spark), target)
    assert os.path.isdir(f"{target}/clean_county") and not os.path.exists(f"{target}/_stage")


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from longstats.session import checkpoint_root

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            checkpoint_root(session(master))
        assert checkpoint_root(session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_memo_follows_the_input_files(spark, tmp_path):
    import shutil

    from longstats.plans import catalog
    for t in catalog.INPUTS:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    first = catalog.long_table(spark, str(tmp_path))
    assert catalog.long_table(spark, str(tmp_path)) is first
    small = first.count()
    for t in catalog.INPUTS:
        (tmp_path / f"{t}.parquet").unlink()
        shutil.copy(f"/root/testdata/sf0.01/{t}.parquet", tmp_path)
    assert catalog.long_table(spark, str(tmp_path)).count() > 5 * small


def test_duplicate_parents(spark):
    from longstats.operators.residual import duplicate_parents
    rows = [(2000, "WHEAT", "W", "A"), (2000, "WHEAT", "W", "A"), (2001, "WHEAT", "W", "A")]
    df = spark.createDataFrame(rows, "year int, commodity_desc string, commodity_class_desc string, state_name string")
    assert [(r.year, r.parent_rows) for r in duplicate_parents(df).collect()] == [(2000, 2)]


def test_reconciliation_as_a_gate(spark):
    import pytest

    from longstats.operators.residual import reconcile_gate, reconcile_levels
    from longstats.plans.job import ReconciliationFailed, run_job
    schema = "k int, n decimal(38,3), y decimal(38,3)"
    dec = lambda x: None if x is None else Decimal(x)
    counties = [(1, dec(100), dec(5)), (2, dec(100), None), (3, None, dec(1)), (4, dec(7), dec(0)), (None, dec(9), dec(9))]
    nation = [(1, dec(100), dec(6)), (2, dec(111), None), (3, dec(5), None), (4, dec(0), dec(0)), (None, dec(10), dec(9))]
    report = reconcile_levels(spark.createDataFrame(counties, schema), spark.createDataFrame(nation, schema), ["k"], ["n", "y"], ("c", "p"))

    def failing(tolerance):
        return {(r.k, r.measure): (r.diff, r.reason) for r in reconcile_gate(report, ["k"], ["n", "y"], ("c", "p"), tolerance).collect()}

    always = {(3, "n"): (None, "missing_c"), (3, "y"): (None, "missing_p"), (4, "n"): (Decimal(7), "over")}
    assert failing(0.2) == always
    assert failing(0.0) == {**always, (1, "y"): (Decimal(-1), "under"), (2, "n"): (Decimal(-11), "under"), (None, "n"): (Decimal(-1), "under")}
    # the job's drops have no national rows
    target = scratch_path(spark, "gated").replace("file:", "")
    with pytest.raises(ReconciliationFailed, match="1 figures"):
        run_job(spark, _raw_drops(spark), target, tolerance=0.1)
    assert os.path.isdir(f"{target}/clean_county") and not os.path.exists(f"{target}/export")
    assert [(r.measure, r.reason) for r in spark.read.parquet(f"{target}/reconciliation").collect()] == [("area_harvested", "missing_national")]


def test_yields_in_their_own_units(spark):
    from longstats.operators.trends import unit_yield_trend
    rows = [(2000, "Cotton", "LB / ACRE", 480.0, Decimal(10), Decimal(15)), (2000, "Cotton", "LB / ACRE", 480.0, Decimal(5), None),
            (2000, "Corn", "BU / ACRE", 1.0, Decimal(2), Decimal(300)), (2000, "Corn", "TONS / ACRE", 1.0, Decimal(4), Decimal(80)),
            (2000, "Rice", "LB / ACRE", 100.0, Decimal(0), Decimal(7)), (2000, "Oats", None, None, Decimal(1), Decimal(7))]
    df = spark.createDataFrame(rows, "year int, commodity_name string, yield_unit string, production_to_yield_multiplier double, "
                                     "area_harvested decimal(38,3), crop_production decimal(38,3)")
    got = {(r.commodity_name, r.yield_unit): r["yield"] for r in unit_yield_trend(df).collect()}
    assert got == {("Cotton", "LB / ACRE"): 480.0, ("Corn", "BU / ACRE"): 150.0, ("Corn", "TONS / ACRE"): 20.0, ("Rice", "LB / ACRE"): None, ("Oats", None): None}
