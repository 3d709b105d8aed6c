import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from longstats.schemas import LONG_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from longstats.session import build_session, checkpoint_root
    session = build_session(master="local[*]", shuffle_partitions=8)
    checkpoint_root(session)  # a private folder only if the session has none
    yield session


DEFAULTS = {
    "source_desc": "SURVEY", "commodity_desc": "CORN", "class_desc": "ALL CLASSES",
    "prodn_practice_desc": "ALL PRODUCTION PRACTICES", "util_practice_desc": "ALL UTILIZATION PRACTICES",
    "statisticcat_desc": "AREA PLANTED", "unit_desc": "ACRES", "short_desc": "X", "domain_desc": "TOTAL",
    "agg_level_desc": "COUNTY", "state_fips_code": "01", "state_alpha": "AL", "state_name": "ALABAMA",
    "county_code": "001", "county_name": "AUTAUGA", "year": 2000, "freq_desc": "ANNUAL",
    "reference_period_desc": "YEAR", "value": "1",
}


def long_rows(spark, rows):
    """Long-schema DataFrame from partial row dicts (other fields take DEFAULTS).
    State and national rows get NULL county fields unless given."""
    full = []
    for r in rows:
        row = dict(DEFAULTS)
        if r.get("agg_level_desc", "COUNTY") != "COUNTY":
            row["county_code"] = None
            row["county_name"] = None
        row.update(r)
        full.append(tuple(row[f.name] for f in LONG_SCHEMA.fields))
    return spark.createDataFrame(full, LONG_SCHEMA)
