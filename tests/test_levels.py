"""Roll-ups, class filters, residual backfill and tidy table: traps T5, T6, T10-T16,
equivalence (one pass = three passes, left = full residual) and closure."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import long_rows
from longstats.operators import (
    clean_levels,
    clean_levels_per_level,
    classify_units,
    core_scope,
    residual_backfill,
    rollup_level,
    tidy_table,
    varied_commodities,
)


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_no_matching_measure_is_null_not_zero_t5(spark):
    core = long_rows(spark, [{"statisticcat_desc": "AREA PLANTED", "value": "10"}])
    row = rollup_level(core, "COUNTY").first()
    assert row.area_planted == Decimal("10.000")
    assert row.area_harvested is None and row.crop_production is None and row.crop_yield is None


def test_varied_commodities_counts_base_class_t10(spark):
    core = long_rows(spark, [
        {"commodity_desc": "WHEAT", "class_desc": "ALL CLASSES"},
        {"commodity_desc": "WHEAT", "class_desc": "WINTER", "source_desc": "CENSUS"},
        {"commodity_desc": "RICE", "class_desc": "ALL CLASSES"},
        {"commodity_desc": "CORN", "class_desc": "ALL CLASSES"},
        {"commodity_desc": "CORN", "class_desc": "OTHER"},
        {"commodity_desc": "COTTON", "class_desc": "PIMA", "agg_level_desc": "STATE"},
        {"commodity_desc": "COTTON", "class_desc": "ALL CLASSES"},
    ])
    # any source counts; CORN is exempt; only county rows count
    assert _rows(varied_commodities(core), "commodity_desc", "class_desc") == [("WHEAT", "ALL CLASSES")]


def test_redundant_total_dropped_and_class_filters_t10_t16(spark):
    core = long_rows(spark, [
        {"commodity_desc": "WHEAT", "class_desc": "ALL CLASSES", "value": "100"},
        {"commodity_desc": "WHEAT", "class_desc": "WINTER", "value": "60"},
        {"commodity_desc": "WHEAT", "class_desc": "ALL CLASSES", "agg_level_desc": "STATE", "value": "150"},
        {"commodity_desc": "WHEAT", "class_desc": "WINTER", "agg_level_desc": "STATE", "value": "90"},
        # class present at state but not county: dropped by the semi join (T16)
        {"commodity_desc": "WHEAT", "class_desc": "DURUM", "agg_level_desc": "STATE", "value": "5"},
        {"commodity_desc": "WHEAT", "class_desc": "WINTER", "agg_level_desc": "NATIONAL",
         "state_alpha": "US", "state_name": "US TOTAL", "state_fips_code": "99", "value": "900"},
    ])
    t = clean_levels(core)
    assert _rows(t.known_county, "class_desc", "area_planted") == [("WINTER", Decimal("60.000"))]
    # the known-class list holds (WHEAT, WINTER) only: state ALL CLASSES and DURUM are dropped
    assert _rows(t.clean_state, "class_desc", "area_planted") == [("WINTER", Decimal("90.000"))]
    assert _rows(t.clean_national, "class_desc", "area_planted") == [("WINTER", Decimal("900.000"))]


def test_corn_silage_branch_order_and_units_t11_t12_t15(spark):
    core = long_rows(spark, [
        {"util_practice_desc": "SILAGE", "statisticcat_desc": "PRODUCTION", "unit_desc": "TONS", "value": "5"},
        {"util_practice_desc": "SILAGE", "statisticcat_desc": "PRODUCTION", "unit_desc": "BU", "value": "7"},
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "PRODUCTION", "unit_desc": "TONS", "value": "9"},
        {"commodity_desc": "POPCORN", "statisticcat_desc": "PRODUCTION", "unit_desc": "BU", "value": "3"},
        {"commodity_desc": "WILD RICE", "statisticcat_desc": "YIELD", "unit_desc": "LB / ACRE", "value": "4"},
        {"commodity_desc": "COTTON", "statisticcat_desc": "PRODUCTION", "unit_desc": "480 LB BALES", "value": "2"},
        {"commodity_desc": "RICE", "statisticcat_desc": "PRODUCTION", "unit_desc": "CWT", "value": "8"},
    ])
    out = {(r.commodity_desc, r.commodity_class_desc): r for r in rollup_level(core, "COUNTY").collect()}
    silage = out[("CORN", "SILAGE")]
    # corn silage in BU falls through the TONS branch into the generic BU branch (T11)
    assert silage.crop_production == Decimal("12.000")
    assert (silage.production_unit, silage.production_unit_conversion, silage.yield_unit) == (
        "TONS", "TONS TO BU", "TONS / ACRE")
    assert silage.production_unit_multiplier == Decimal("35.714")
    grain = out[("CORN", "GRAIN")]
    assert grain.crop_production is None            # TONS is only counted for silage
    assert grain.production_unit_multiplier == Decimal("0.028")
    popcorn = out[("POPCORN", "ALL CLASSES")]       # substring match gets BU units (T12)
    assert (popcorn.production_unit, popcorn.yield_unit, popcorn.crop_production) == ("BU", "BU / ACRE",
                                                                                      Decimal("3.000"))
    wild = out[("WILD RICE", "ALL CLASSES")]        # contains RICE: LB / ACRE yield but no production unit
    assert (wild.production_unit, wild.yield_unit, wild.crop_yield) == (None, "LB / ACRE", Decimal("4.000"))
    assert wild.production_to_yield_multiplier is None
    assert out[("COTTON", "ALL CLASSES")].production_to_yield_multiplier == 480.0
    assert out[("RICE", "ALL CLASSES")].production_to_yield_multiplier == 100.0
    assert out[("RICE", "ALL CLASSES")].crop_production == Decimal("8.000")


def test_corn_effective_class(spark):
    core = long_rows(spark, [
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA PLANTED", "value": "10"},
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA HARVESTED", "value": "8"},
    ])
    got = _rows(rollup_level(core, "COUNTY"), "commodity_class_desc", "commodity_class_variety")
    assert got == [("AREA PLANTED (ONLY)", "Area Planted (Only)"), ("GRAIN", "Grain")]


def test_two_yields_in_one_group_are_summed_t14(spark):
    core = long_rows(spark, [
        {"commodity_desc": "SOYBEANS", "statisticcat_desc": "YIELD", "unit_desc": "BU / ACRE", "value": "40"},
        {"commodity_desc": "SOYBEANS", "statisticcat_desc": "YIELD", "unit_desc": "BU / ACRE", "value": "50"},
    ])
    assert rollup_level(core, "COUNTY").first().crop_yield == Decimal("90.000")


def _state_and_counties(spark, state_value, county_values, extra=()):
    rows = [{"commodity_desc": "SOYBEANS", "agg_level_desc": "STATE", "value": state_value}]
    rows += [{"commodity_desc": "SOYBEANS", "county_code": f"{i:03d}", "county_name": f"C{i}", "value": v}
             for i, v in enumerate(county_values)]
    return long_rows(spark, rows + list(extra))


def test_zero_residual_becomes_null_and_row_is_dropped_t6(spark):
    t = clean_levels(_state_and_counties(spark, "30", ["10", "20"]))
    unspecified = residual_backfill(t.clean_state, t.known_county)
    assert unspecified.first().area_planted is None
    tidy = tidy_table(t.known_county, unspecified)
    assert tidy.filter(F.col("county_name") == "Unspecified").count() == 0
    assert tidy.count() == 2


def test_negative_residual_is_kept(spark):
    t = clean_levels(_state_and_counties(spark, "25", ["10", "20"]))
    tidy = tidy_table(t.known_county, residual_backfill(t.clean_state, t.known_county))
    row = tidy.filter(F.col("county_name") == "Unspecified").first()
    assert row.area_planted == Decimal("-5.000")
    assert row.fips_county_code is None and row.crop_yield is None
    assert row.state_name == "Alabama" and row.commodity_name == "Soybeans"


def test_state_only_and_county_only_keys(spark):
    rows = [
        {"commodity_desc": "SOYBEANS", "agg_level_desc": "STATE", "year": 2001, "value": "40"},  # state only
        {"commodity_desc": "SOYBEANS", "year": 2002, "value": "15"},                              # county only
        {"commodity_desc": "SOYBEANS", "year": 2001, "county_code": "002", "state_name": "GEORGIA",
         "state_alpha": "GA", "value": "1"},
    ]
    t = clean_levels(long_rows(spark, rows))
    full = residual_backfill(t.clean_state, t.known_county, how="full")
    left = residual_backfill(t.clean_state, t.known_county, how="left")
    assert full.count() == 3 and left.count() == 1
    assert left.first().area_planted == Decimal("40.000")
    right_only = full.filter(F.col("year").isNull())
    assert _rows(right_only, "county_state_name", "area_planted") == [("ALABAMA", None), ("GEORGIA", None)]


def test_duplicate_state_rows_each_subtract_t13(spark):
    rows = [
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA HARVESTED", "class_desc": "ALL CLASSES",
         "value": "10"},
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA HARVESTED", "class_desc": "YELLOW",
         "county_code": "002", "value": "5"},
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA HARVESTED", "class_desc": "ALL CLASSES",
         "agg_level_desc": "STATE", "value": "100"},
        {"util_practice_desc": "GRAIN", "statisticcat_desc": "AREA HARVESTED", "class_desc": "YELLOW",
         "agg_level_desc": "STATE", "value": "50"},
    ]
    t = clean_levels(long_rows(spark, rows))
    unspecified = residual_backfill(t.clean_state, t.known_county)
    # both state rows share effective class GRAIN; each subtracts the whole county sum (15)
    assert sorted(r.area_harvested for r in unspecified.collect()) == [Decimal("35.000"), Decimal("85.000")]


def test_classify_units_after_aggregation(spark):
    df = spark.createDataFrame([("CORN", "SILAGE"), ("SOYBEANS", "ALL CLASSES"), ("BARLEY", "ALL CLASSES")],
                               "commodity_desc string, commodity_class_desc string")
    got = {r.commodity_desc: r for r in classify_units(df).collect()}
    assert got["BARLEY"].production_unit is None and got["BARLEY"].production_unit_conversion == "NO CONVERSION"
    assert got["SOYBEANS"].production_unit == "BU" and got["SOYBEANS"].production_to_yield_multiplier == 1.0


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_one_pass_equals_three_pass_on_fixture(spark):
    from longstats.plans import catalog
    core = core_scope(catalog.long_table(spark, "/root/testdata/sf0.001"), min_year=1996)
    one, three = clean_levels(core), clean_levels_per_level(core)
    for name in ("known_county", "clean_state", "clean_national"):
        assert _sorted(getattr(one, name)) == _sorted(getattr(three, name)), name


def test_left_residual_equals_full_after_filter_and_closure(spark):
    from longstats.plans import catalog
    core = core_scope(catalog.long_table(spark, "/root/testdata/sf0.01"), min_year=1996)
    t = clean_levels(core)
    full = residual_backfill(t.clean_state, t.known_county, how="full")
    left = residual_backfill(t.clean_state, t.known_county, how="left")
    assert _sorted(tidy_table(t.known_county, full)) == _sorted(tidy_table(t.known_county, left))

    # closure: sum(known counties) + residual = state value, per state key with one state row
    keys = ["year", "commodity_desc", "commodity_class_desc", "state_name"]
    single = t.clean_state.groupBy(*keys).count().filter("count = 1").drop("count")
    state = t.clean_state.join(single, keys, "left_semi").filter(F.col("area_planted").isNotNull())
    counties = t.known_county.groupBy(*keys).agg(F.sum("area_planted").alias("k"))
    resid = left.select(*keys, F.col("area_planted").alias("r"))
    check = (state.select(*keys, F.col("area_planted").alias("s")).join(counties, keys, "left")
             .join(resid, keys, "left")
             .filter(F.coalesce("k", F.lit(0)) + F.coalesce("r", F.lit(0)) != F.col("s")))
    assert state.count() > 0
    assert check.count() == 0
