"""Every registered query against its DuckDB oracle (sf0.001 here; the driver uses
sf0.01), and no Python evaluation node in any plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from longstats.plans.queries import QUERIES  # noqa: E402
from check_oracles import compare, duck  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_oracles_import_nothing_from_the_engine():
    import longstats.plans.oracle_sql as module
    with open(module.__file__) as f:
        text = f.read()
    assert "longstats.functions" not in text and "longstats.operators" not in text


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert node not in plan, f"{name}: {node}"
    ok, msg = compare(df, entry.oracle_sql()[name], con)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "harvested", "planted", "production", "yield"]
