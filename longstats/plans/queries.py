"""Registered queries: one per operator / job of the survey, each reading the driver
tables (through the derived long view) and paired with a DuckDB oracle.

Fixed parameters (chosen for the derived fixture, whose years are 1995-2001):
``MIN_YEAR = 1996`` makes the core year filter bite; the trend crop is
Soybeans; the converted trend uses Corn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from longstats.functions.collections import asc_ref
from longstats.functions.numbers import parse_grouped_decimal, year_date
from longstats.functions.text import county_id, normalise_nulls, title_case
from longstats.operators import levels as lv
from longstats.operators import profile as pf
from longstats.operators.pivot import conditional_pivot
from longstats.operators.residual import (
    RESIDUAL_KEYS,
    duplicate_parents,
    reconcile_levels,
    residual_backfill,
    rollup_measures,
    union_aligned,
)
from longstats.operators.scope import crop_filter, effective_class, level_scope
from longstats.operators.trends import yield_trend
from longstats.operators.units import classify_units
from longstats.operators.windows import with_grand_total
from longstats.plans.job import TIDY_CLUSTER
from longstats.schemas import DIMENSION_SCHEMA, LONG_SCHEMA, TIDY_SCHEMA
from longstats.session import materialize, scratch_path
from longstats.sources.delimited import read_delimited, read_dimension, read_escaped, read_with_quarantine
from longstats.sources.export import ROWS_PER_FILE, escaped_fields, export_check, export_delimited, export_manifest
from longstats.sources.layout import load_table, write_table
from longstats.streaming.landing import land_stream
from longstats.plans import analysis
from longstats.plans import oracle_sql as o
from longstats.plans.base import MIN_YEAR, Query, _core, _job, _long, comparable, county_dimension

TREND_CROP = "Soybeans"
CONVERTED_TREND_CROP = "Corn"
LABEL_YEAR = 1998
HOME_COUNTRY = "AMERICA"
#: A raw class that the long view doesn't have.
SECOND_CLASS = "TRADITIONAL OR INDIAN"
#: The text columns of the long view: all but the year.
HEADER_COLUMNS = [f.name for f in LONG_SCHEMA.fields if f.name != "year"]
SPARSE_STATES = ("NATION_3", "NATION_7")
PROBE = {
    "class_desc": ("SPRING, (EXCL DURUM)", "WINTER"),
    "util_practice_desc": ("ALL UTILIZATION PRACTICES",),
    "unit_desc": ("ACRES", "BU"),
    "state_fips_code": ("01", "99"),
    "state_alpha": ("N0", "US"),
    "year": (1996, 2001),
}
GRAND_TOTAL_FILTER = {
    "commodity_desc": "CORN", "year": 1997, "domain_desc": "TOTAL", "unit_desc": "ACRES",
    "statisticcat_desc": "AREA HARVESTED", "short_desc": "CORN, GRAIN - AREA HARVESTED",
    "source_desc": "SURVEY", "reference_period_desc": "YEAR",
}


def _in_all(spec: dict) -> F.Column:
    cond = F.lit(True)
    for col, values in spec.items():
        cond = cond & F.col(col).isin(list(values))
    return cond


def _eq_all(spec: dict) -> F.Column:
    cond = F.lit(True)
    for col, value in spec.items():
        cond = cond & (F.col(col) == value)
    return cond


def _sql_in_all(spec: dict) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return " AND ".join(f"{c} IN ({', '.join(lit(v) for v in vs)})" for c, vs in spec.items())


def _sql_eq_all(spec: dict) -> str:
    return " AND ".join(f"{c} = {v}" if isinstance(v, int) else f"{c} = '{v}'" for c, v in spec.items())


# ----------------------------------------------------------------- scope & columns

def q_core_scope(spark, sf):
    return _core(spark, sf)


def q_level_scope(spark, sf):
    return level_scope(_core(spark, sf), "COUNTY")


def q_probe_rows(spark, sf):
    return _long(spark, sf).filter(_in_all(PROBE))


def q_effective_class(spark, sf):
    return (_core(spark, sf).select("commodity_desc", "statisticcat_desc", "util_practice_desc", "class_desc",
                                    effective_class().alias("commodity_class_desc")).distinct())


def q_classify_units(spark, sf):
    pairs = _core(spark, sf).select("commodity_desc", effective_class().alias("commodity_class_desc")).distinct()
    return comparable(classify_units(pairs))


TITLE_SOURCES = ["class_desc", "county_name", "state_name", "commodity_desc", "short_desc",
                 "util_practice_desc", "statisticcat_desc"]


def q_title_case(spark, sf):
    # one scan: every source column exploded into one value column, then distinct
    raw = _long(spark, sf).select(F.explode(F.array(*TITLE_SOURCES)).alias("raw")).distinct()
    return raw.select("raw", title_case("raw").alias("titled"))


def q_county_id(spark, sf):
    return (_long(spark, sf).select("agg_level_desc", "state_fips_code", "county_code",
                                    county_id().alias("fips_county_code")).distinct())


def q_parse_number(spark, sf):
    return comparable(_long(spark, sf).select("value").distinct()
                      .withColumn("number", parse_grouped_decimal("value", 38, 3)))


def q_parse_number_int(spark, sf):
    return comparable(_long(spark, sf).select("value").distinct()
                      .withColumn("number", parse_grouped_decimal("value", 38, 0)))


def q_year_date(spark, sf):
    return comparable(_long(spark, sf).select("year").distinct().withColumn("calendar_date", year_date("year")))


def q_normalise_nulls(spark, sf):
    tokened = _long(spark, sf).select(
        "agg_level_desc", "year",
        F.coalesce("county_name", F.lit("")).alias("county_name"),
        F.when(F.col("state_name") == SPARSE_STATES[0], F.lit("NULL")).otherwise(F.col("state_name")).alias("state_name"),
        F.when(F.col("value").isNull(), F.lit("\\N")).when(F.col("value") == "(D)", F.lit(" null "))
         .otherwise(F.col("value")).alias("value"))
    return normalise_nulls(tokened)


# ----------------------------------------------------------------- pivots & classes

def q_conditional_pivot(spark, sf):
    core = _core(spark, sf).withColumn("num", parse_grouped_decimal("value"))   # parsed once per row
    planted = (F.col("statisticcat_desc") == "AREA PLANTED") & (F.col("unit_desc") == "ACRES")
    measures = {f"{lvl.lower()}_planted": (planted & (F.col("agg_level_desc") == lvl), F.col("num"))
                for lvl in lv.LEVELS}
    return comparable(conditional_pivot(core, ["year", "commodity_desc"], measures))


def q_source_stat_pivot(spark, sf):
    return comparable(pf.source_stat_pivot(_core(spark, sf), "COUNTY"))


def q_distinct_nondefault(spark, sf):
    return pf.distinct_nondefault(pf.source_stat_pivot(_core(spark, sf)), "util_practice_desc",
                                  "ALL UTILIZATION PRACTICES")


def q_distinct_nondefault_class(spark, sf):
    return pf.distinct_nondefault(pf.source_stat_pivot(_core(spark, sf)), "class_desc", "ALL CLASSES")


def q_varied_commodities(spark, sf):
    return lv.varied_commodities(_core(spark, sf))


def q_classes_of_varied(spark, sf):
    return pf.varied_classes(_core(spark, sf))


def q_drop_redundant_totals(spark, sf):
    core = _core(spark, sf)
    # the list first: its size is known when the join is planned
    redundant = materialize(lv.varied_commodities(core), "redundant_totals")
    kept = lv.drop_redundant_totals(level_scope(core, "COUNTY"), redundant)
    return kept.groupBy("commodity_desc", "class_desc").agg(F.count(F.lit(1)).alias("row_count"))


def q_keep_known_classes(spark, sf):
    job = _job(spark, sf)
    known = materialize(lv.known_classes(job.levels.known_county), "known_classes")
    kept = lv.keep_known_classes(level_scope(job.core, "STATE"), known)
    return kept.groupBy("commodity_desc", "class_desc").agg(F.count(F.lit(1)).alias("row_count"))


# ----------------------------------------------------------------- the cleaning job

def q_rollup_level(spark, sf):
    return comparable(lv.rollup_level(_core(spark, sf), "STATE"))


def q_rollup_county(spark, sf):
    return comparable(_job(spark, sf).levels.known_county)


def q_rollup_state(spark, sf):
    return comparable(_job(spark, sf).levels.clean_state)


def q_rollup_national(spark, sf):
    return comparable(_job(spark, sf).levels.clean_national)


def q_rollup_to_state(spark, sf):
    return comparable(rollup_measures(_job(spark, sf).levels.known_county, RESIDUAL_KEYS))


def q_residual_full(spark, sf):
    t = _job(spark, sf).levels
    return comparable(residual_backfill(t.clean_state, t.known_county, how="full"))


def q_residual_left(spark, sf):
    return comparable(_job(spark, sf).unspecified)


def q_tidy_table(spark, sf):
    return comparable(_job(spark, sf).tidy)


def q_tidy_union(spark, sf):
    job = _job(spark, sf)
    return comparable(union_aligned(job.levels.known_county, job.unspecified))


def q_yield_trend(spark, sf):
    return comparable(yield_trend(_job(spark, sf).tidy, TREND_CROP))


def q_yield_trend_converted(spark, sf):
    return comparable(yield_trend(_job(spark, sf).levels.clean_national, CONVERTED_TREND_CROP, convert=True))


def q_reconcile_levels(spark, sf):
    job = _job(spark, sf)
    return comparable(reconcile_levels(
        job.tidy, job.levels.clean_national, ["year", "commodity_name", "commodity_class_variety"],
        ["area_planted", "area_harvested", "crop_production"], names=("county", "national")))


# ----------------------------------------------------------------- windows & totals

def _level_total(spark, sf, level: str, scale: int) -> DataFrame:
    rows = _long(spark, sf).filter(_eq_all(GRAND_TOTAL_FILTER) & (F.col("agg_level_desc") == level))
    per_state = rows.groupBy("state_name").agg(
        F.sum(parse_grouped_decimal("value", 38, scale)).alias("acres_harvested"))
    return comparable(with_grand_total(per_state, "acres_harvested", "total_us_harvested"))


def q_grand_total(spark, sf):
    return _level_total(spark, sf, "STATE", 3)


def q_grand_total_int(spark, sf):
    return _level_total(spark, sf, "NATIONAL", 0)


def q_partition_total(spark, sf):
    return comparable(pf.label_breakdown(_long(spark, sf), "COUNTY", LABEL_YEAR))


def q_partition_total_state(spark, sf):
    return comparable(pf.label_breakdown(_long(spark, sf), "STATE", LABEL_YEAR,
                                         practice="ALL PRODUCTION PRACTICES"))


def q_variety_from_label(spark, sf):
    return _long(spark, sf).select("short_desc").distinct().withColumns(pf.variety_from_label())


# ----------------------------------------------------------------- profiles

def _scoped_raw(spark, sf) -> DataFrame:
    return _long(spark, sf).filter((F.col("year") >= MIN_YEAR) & crop_filter())


def q_period_profile(spark, sf):
    return pf.period_profile(_scoped_raw(spark, sf), "freq_desc", "reference_period_desc")


def q_row_count(spark, sf):
    return pf.row_count(_long(spark, sf))


def q_check_load(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    return pf.check_load(_long(spark, sf), lineitem, _in_all(PROBE))


def q_states_present(spark, sf):
    return pf.distinct_combos(_long(spark, sf), ["state_name"])


def q_null_key_levels(spark, sf):
    return pf.null_key_levels(_long(spark, sf))


def q_names_shared(spark, sf):
    return pf.names_shared(_long(spark, sf))


def _with_country(spark, sf) -> DataFrame:
    """The long rows with the region of their state (through nation) as the country; NULL above the states."""
    places = (spark.read.parquet(f"{sf}/nation.parquet").select("n_name", "n_regionkey")
              .join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_name", F.col("r_name").alias("country_name")))
    return _long(spark, sf).join(places, F.col("state_name") == F.col("n_name"), "left").drop("n_name")


def q_country_profile(spark, sf):
    return pf.distinct_combos(_with_country(spark, sf), ["country_name"])


def q_country_rows(spark, sf):
    """All rows of the countries that are not the profile's first: the reference lists what lies outside one country."""
    return _with_country(spark, sf).filter(F.col("country_name") != HOME_COUNTRY)


def q_duplicate_parents(spark, sf):
    """Parent rows that share the residual's keys: each of them has the children's whole sum subtracted.

    Corn rows in dollars are given a raw class of their own; corn's effective class doesn't follow the raw one, so
    states that report both have two parent rows for one key.
    """
    second = (F.col("commodity_desc") == "CORN") & (F.col("unit_desc") == "$")
    core = _core(spark, sf).withColumn("class_desc", F.when(second, SECOND_CLASS).otherwise(F.col("class_desc")))
    return duplicate_parents(lv.rollup_level(core, "STATE"))


def q_census_years(spark, sf):
    return (pf.distinct_combos(_long(spark, sf), ["year"], F.col("source_desc") == "CENSUS")
            .orderBy(asc_ref("year")))


def q_state_profile(spark, sf):
    prof = pf.coverage_profile(_scoped_raw(spark, sf))
    return prof.select(
        "state_name",
        F.array_join(F.col("production_years").cast("array<string>"), ",").alias("production_years"),
        F.array_join("commodities_produced", ",").alias("commodities_produced"),
        F.array_join("commodities_produced_year", ",").alias("commodities_produced_year"),
        "unique_commodities")


def q_numeric_format_profile(spark, sf):
    return pf.numeric_format_profile(_long(spark, sf))


def q_unit_inventory(spark, sf):
    return pf.unit_inventory(_long(spark, sf))


def q_distinct_combos(spark, sf):
    cond = F.col("state_name").isin(list(SPARSE_STATES)) & crop_filter() & (F.col("source_desc") == "SURVEY")
    return (pf.distinct_combos(_long(spark, sf), ["state_name", "source_desc", "statisticcat_desc",
                                                  "commodity_desc", "unit_desc", "value"], cond)
            # the other columns refine the order, so that the range partitioner can split a state
            .orderBy(*[asc_ref(c) for c in ("state_name", "source_desc", "statisticcat_desc", "commodity_desc",
                                            "unit_desc", "value")]))


def q_ordered_profile(spark, sf):
    return pf.period_profile(_long(spark, sf), "state_name").orderBy(asc_ref("state_name"))



# ----------------------------------------------------------------- sources & sinks
# Each of these writes data Spark derives from the driver tables (the long view
# or the tidy table) to a fresh folder under the shared checkpoint directory,
# then reads it back through the operator under test.

def _export(df: DataFrame, name: str, single_file: bool = False) -> str:
    path = scratch_path(df.sparkSession, name)
    export_delimited(df, path, single_file=single_file)
    return path


def _escaped_variant(long: DataFrame) -> DataFrame:
    """Long rows with separators, backslashes, newlines and leading '#' in the text."""
    return long.withColumns({
        "short_desc": F.replace("short_desc", F.lit(" - "), F.lit("\t- \\")),
        "county_name": F.replace("county_name", F.lit("COUNTY-"), F.lit("#COUNTY\n")),
    })


def _plain_export(df: DataFrame, name: str) -> str:
    """Tab-separated text without any escape, header per file (the data must hold no tab or line break)."""
    path = scratch_path(df.sparkSession, name)
    (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite")
     .option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "")
     .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))
    return path


def _backslashed(long: DataFrame) -> DataFrame:
    """Long rows whose labels hold backslashes: data for a reader without escapes."""
    return long.withColumn("short_desc", F.replace("short_desc", F.lit(" - "), F.lit(" \\t ")))


def q_scan_delimited(spark, sf):
    return read_delimited(spark, _plain_export(_backslashed(_long(spark, sf)), "scan-delimited"), LONG_SCHEMA)


def _header_rows(spark, sf) -> DataFrame:
    """All long rows, the text columns only; corn rows are given the header's own words as their data."""
    return _long(spark, sf).select(*[F.when(F.col("commodity_desc") == "CORN", F.lit(c)).otherwise(F.col(c)).alias(c)
                                     for c in HEADER_COLUMNS])


def _text_schema() -> StructType:
    return StructType([LONG_SCHEMA[c] for c in HEADER_COLUMNS])


def q_scan_header_like_rows(spark, sf):
    """Rows that equal the header survive: only the first line of each file is skipped."""
    return read_escaped(spark, _plain_export(_header_rows(spark, sf), "header-like"), _text_schema())


def q_scan_mixed_headers(spark, sf):
    """Two folders read together, whose files have differently written headers."""
    rows = _header_rows(spark, sf)
    corn = F.col("commodity_desc") == "commodity_desc"
    lower = _plain_export(rows.filter(corn), "lower-headers")
    upper = _plain_export(rows.filter(~corn).toDF(*[c.upper() for c in HEADER_COLUMNS]), "upper-headers")
    return read_escaped(spark, [lower, upper], _text_schema())


def q_scan_trim(spark, sf):
    padded = _long(spark, sf).withColumn("value", F.concat(F.lit("  "), F.col("value"), F.lit(" ")))
    return read_delimited(spark, _export(padded, "scan-trim"), LONG_SCHEMA, trim=True)


def q_scan_escaped(spark, sf):
    path = _export(_escaped_variant(_long(spark, sf)), "scan-escaped")
    return read_escaped(spark, path, LONG_SCHEMA)


def _raw_line() -> F.Column:
    """The escaped line of a long row."""
    return F.concat_ws("\t", escaped_fields([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LONG_SCHEMA.fieldNames()]))


def _broken(line: F.Column) -> F.Column:
    """The line with a byte in front that UTF-8 doesn't allow there."""
    return F.concat(F.unhex(F.lit("C3")), F.encode(line, "UTF-8")).cast("string")


def q_scan_utf8(spark, sf):
    """National rows carry an invalid byte; the load drops them."""
    long = _long(spark, sf)
    line = _raw_line()
    path = scratch_path(spark, "scan-utf8")
    long.select(F.when(F.col("agg_level_desc") == "NATIONAL", _broken(line)).otherwise(line).alias("value")
                ).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).text(path, compression="gzip")
    return read_escaped(spark, path, LONG_SCHEMA, header=False, validate_utf8=True, mode="DROPMALFORMED")


def _quarantine_input(spark, sf) -> str:
    """Escaped lines without header; WATERSHED rows carry one extra field, NATIONAL rows an invalid byte, and
    irrigated rows a year that is no number."""
    long = _long(spark, sf)
    line = _raw_line()
    bad_year = F.replace(line, F.concat(F.lit("\t"), F.col("year").cast("string"), F.lit("\tANNUAL")), F.lit("\tn/a\tANNUAL"))
    level = F.col("agg_level_desc")
    text = (F.when(level == "WATERSHED", F.concat(line, F.lit("\textra"))).when(level == "NATIONAL", _broken(line))
            .when(F.col("prodn_practice_desc") == "IRRIGATED", bad_year).otherwise(line))
    path = scratch_path(spark, "scan-quarantine")
    long.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).text(path, compression="gzip")
    return path


def q_scan_quarantine(spark, sf):
    good, _ = read_with_quarantine(spark, _quarantine_input(spark, sf), LONG_SCHEMA, header=False)
    return good


def q_scan_rejects(spark, sf):
    _, bad = read_with_quarantine(spark, _quarantine_input(spark, sf), LONG_SCHEMA, header=False)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


def _tidy_export(spark, sf) -> tuple[DataFrame, str]:
    tidy = _job(spark, sf).tidy
    return tidy, _export(tidy, "export-tsv")


def q_export_tsv(spark, sf):
    _, path = _tidy_export(spark, sf)
    return comparable(read_escaped(spark, path, TIDY_SCHEMA))


def q_export_manifest(spark, sf):
    """One row: every listed file holds bytes, and the files' rows add up to the table's."""
    _, path = _tidy_export(spark, sf)
    listed = export_manifest(spark, path).filter(F.col("path").endswith(".gz"))
    per_file = (spark.read.text(path).groupBy(F.input_file_name().alias("path"))
                .agg((F.count(F.lit(1)) - 1).alias("file_rows")))  # without the header line
    return (listed.agg(F.count(F.lit(1)).alias("files"), F.min("length").alias("least"))
            .select((F.col("files") > 0).alias("has_files"), (F.col("least") > 0).alias("all_hold_bytes"),
                    per_file.agg(F.sum("file_rows")).select(F.col("sum(file_rows)")).scalar().alias("exported_rows")))


def q_export_check(spark, sf):
    tidy, path = _tidy_export(spark, sf)
    return export_check(read_escaped(spark, path, TIDY_SCHEMA), tidy)


def q_scan_dimension(spark, sf):
    path = _export(county_dimension(_long(spark, sf)), "dimension")
    return read_dimension(spark, path)


def q_layout_write(spark, sf):
    path = scratch_path(spark, "layout")
    write_table(_long(spark, sf), path)
    return spark.read.parquet(path)


def q_layout_tidy(spark, sf):
    """The tidy table by year, clustered by county id."""
    path = scratch_path(spark, "layout-tidy")
    tidy = _job(spark, sf).tidy
    write_table(tidy, path, cluster_by=TIDY_CLUSTER)
    return comparable(spark.read.parquet(path).select(*tidy.columns))


def q_load_table(spark, sf):
    """Sample load, then truncate and full reload into the same table."""
    long = _long(spark, sf)
    target = scratch_path(spark, "loaded")
    sample = _export(long.filter(F.col("year") == MIN_YEAR), "load-sample")
    load_table(spark, sample, target, LONG_SCHEMA)
    return load_table(spark, _export(long, "load-full"), target, LONG_SCHEMA)


def q_stream_landing(spark, sf):
    drops = _plain_export(_backslashed(_long(spark, sf)), "drops")
    target = scratch_path(spark, "landed")
    land_stream(spark, drops, LONG_SCHEMA, target)
    return spark.read.parquet(target)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
QUERIES.update(analysis.QUERIES)

# ----------------------------------------------------------------- oracles

_PARSE = "SELECT value, CAST({num} AS DOUBLE) AS number FROM (SELECT DISTINCT value FROM long) v"
_TITLE_UNION = " UNION ".join(f"SELECT {c} AS raw FROM long" for c in TITLE_SOURCES)
_COUNTRY = ("SELECT l.*, r_name AS country_name FROM long l LEFT JOIN (SELECT n_name, r_name FROM nation "
            "JOIN region ON r_regionkey = n_regionkey) p ON p.n_name = l.state_name")
_BACKSLASHED = "SELECT * REPLACE (replace(short_desc, ' - ', ' \\t ') AS short_desc) FROM long"
_HEADER_ROWS = ("SELECT " + ", ".join(f"CASE WHEN commodity_desc = 'CORN' THEN '{c}' ELSE {c} END AS {c}" for c in HEADER_COLUMNS)
                + " FROM long")
_PLANTED = "statisticcat_desc = 'AREA PLANTED' AND unit_desc = 'ACRES'"
_SOURCE_STAT = f"""
SELECT year, CAST(make_date(year, 1, 1) AS VARCHAR) AS year_date, commodity_desc, class_desc, prodn_practice_desc,
  util_practice_desc, unit_desc, state_alpha, state_name,
""" + ",\n".join(
    f"  CAST(SUM(CASE WHEN source_desc = '{src}' AND domain_desc = 'TOTAL' AND statisticcat_desc = '{stat}' "
    f"THEN {o.num('value', 0)} END) AS DOUBLE) AS {prefix}_{src.lower()}"
    for stat, prefix in [("AREA PLANTED", "area_planted"), ("AREA HARVESTED", "area_harvested"),
                         ("YIELD", "area_yield"), ("PRODUCTION", "area_production")]
    for src in ("CENSUS", "SURVEY")) + f"""
FROM core WHERE agg_level_desc = 'COUNTY' AND statisticcat_desc IN {o.STATS} AND reference_period_desc = 'YEAR'
  AND unit_desc = 'ACRES'
GROUP BY year, commodity_desc, class_desc, prodn_practice_desc, util_practice_desc, unit_desc, state_alpha,
  state_name"""


def _label_sql(level: str, practice: bool) -> str:
    extra = "AND prodn_practice_desc = 'ALL PRODUCTION PRACTICES'" if practice else ""
    group = "split_part(short_desc, ' - ', 1)"
    return f"""
SELECT *, CAST(SUM(vn) OVER (PARTITION BY commodity_desc, statisticcat_desc, unit_desc) AS DOUBLE) AS total_value,
  CAST(vn AS DOUBLE) AS value_number
FROM (
  SELECT commodity_desc, statisticcat_desc, short_desc, class_desc, util_practice_desc, unit_desc,
    prodn_practice_desc, domain_desc, {group} AS commodity_group,
    COALESCE(NULLIF(split_part({group}, ',', 3), ''), NULLIF(split_part({group}, ',', 2), '')) AS commodity_variety,
    SUM({o.num('value')}) AS vn
  FROM long
  WHERE year = {LABEL_YEAR} AND {o.CROP} AND source_desc = 'SURVEY' AND reference_period_desc = 'YEAR'
    AND agg_level_desc = '{level}' AND statisticcat_desc IN {o.STATS} {extra}
  GROUP BY ALL) x"""


def _total_sql(level: str, scale: int) -> str:
    return f"""
SELECT state_name, CAST(acres AS DOUBLE) AS acres_harvested,
  CAST(SUM(acres) OVER () AS DOUBLE) AS total_us_harvested
FROM (SELECT state_name, SUM({o.num('value', scale)}) AS acres FROM long
      WHERE {_sql_eq_all(GRAND_TOTAL_FILTER)} AND agg_level_desc = '{level}' GROUP BY state_name) t"""


ORACLES: dict[str, str] = {
    "core_scope": o.WITH_CORE + "SELECT * FROM core",
    "level_scope": o.WITH_CORE + f"SELECT * FROM core WHERE agg_level_desc = 'COUNTY' AND {o.SCOPE}",
    "probe_rows": o.WITH_LONG + f"SELECT * FROM long WHERE {_sql_in_all(PROBE)}",
    "effective_class": o.WITH_CORE + ("SELECT DISTINCT commodity_desc, statisticcat_desc, util_practice_desc, "
                                      f"class_desc, {o.EFF} AS commodity_class_desc FROM core"),
    "classify_units": o.WITH_CORE + (
        "SELECT commodity_desc, commodity_class_desc, production_unit, production_unit_conversion, "
        "CAST(production_unit_multiplier AS DOUBLE) AS production_unit_multiplier, yield_unit, "
        f"production_to_yield_multiplier FROM (SELECT commodity_desc, commodity_class_desc, {o.UNITS} "
        f"FROM (SELECT DISTINCT commodity_desc, {o.EFF} AS commodity_class_desc FROM core) p) u"),
    "title_case": o.WITH_LONG + f"SELECT raw, {o.title('raw')} AS titled FROM ({_TITLE_UNION}) t",
    "county_id": o.WITH_LONG + ("SELECT DISTINCT agg_level_desc, state_fips_code, county_code, "
                                "state_fips_code || county_code AS fips_county_code FROM long"),
    "parse_number": o.WITH_LONG + _PARSE.format(num=o.num("value", 3)),
    "parse_number_int": o.WITH_LONG + _PARSE.format(num=o.num("value", 0)),
    "year_date": o.WITH_LONG + ("SELECT year, CAST(make_date(year, 1, 1) AS VARCHAR) AS calendar_date "
                                "FROM (SELECT DISTINCT year FROM long) y"),
    "normalise_nulls": o.WITH_LONG + ("SELECT agg_level_desc, year, county_name, "
                                      f"NULLIF(state_name, '{SPARSE_STATES[0]}') AS state_name, "
                                      "CASE WHEN value = '(D)' THEN NULL ELSE value END AS value FROM long"),
    "conditional_pivot": o.WITH_CORE + "SELECT year, commodity_desc, " + ", ".join(
        f"CAST(SUM(CASE WHEN {_PLANTED} AND agg_level_desc = '{lvl}' THEN {o.num('value')} END) AS DOUBLE) "
        f"AS {lvl.lower()}_planted" for lvl in ("COUNTY", "STATE", "NATIONAL")) + " FROM core GROUP BY 1, 2",
    "source_stat_pivot": o.WITH_CORE + _SOURCE_STAT,
    "distinct_nondefault": o.WITH_CORE + ("SELECT DISTINCT commodity_desc FROM (" + _SOURCE_STAT + ") p "
                                          "WHERE util_practice_desc <> 'ALL UTILIZATION PRACTICES'"),
    "distinct_nondefault_class": o.WITH_CORE + ("SELECT DISTINCT commodity_desc FROM (" + _SOURCE_STAT + ") p "
                                                "WHERE class_desc <> 'ALL CLASSES'"),
    "varied_commodities": f"WITH {o.LONG},\n{o.CORE},\n{o.CWV}\nSELECT * FROM cwv",
    "classes_of_varied": o.WITH_CORE + (
        "SELECT c.commodity_desc, c.class_desc FROM core c JOIN (SELECT commodity_desc FROM core "
        "GROUP BY commodity_desc HAVING COUNT(DISTINCT class_desc) > 1) v ON c.commodity_desc = v.commodity_desc "
        "GROUP BY 1, 2"),
    "drop_redundant_totals": f"WITH {o.LONG},\n{o.CORE},\n{o.CWV}\n" + (
        f"SELECT commodity_desc, class_desc, COUNT(*) AS row_count FROM core WHERE agg_level_desc = 'COUNTY' "
        f"AND {o.SCOPE} {o.NOT_REDUNDANT} GROUP BY 1, 2"),
    "keep_known_classes": o.WITH_JOB + (
        f"SELECT commodity_desc, class_desc, COUNT(*) AS row_count FROM core WHERE agg_level_desc = 'STATE' "
        f"AND {o.SCOPE} {o.KNOWN_CLASS} GROUP BY 1, 2"),
    "rollup_level": f"WITH {o.LONG},\n{o.CORE},\nlvl AS ({o.level_sql('STATE')})\nSELECT {o.LEVEL_OUT} FROM lvl",
    "rollup_county": o.WITH_JOB + f"SELECT {o.LEVEL_OUT} FROM known_county",
    "rollup_state": o.WITH_JOB + f"SELECT {o.LEVEL_OUT} FROM clean_state",
    "rollup_national": o.WITH_JOB + f"SELECT {o.LEVEL_OUT} FROM clean_national",
    "rollup_to_state": o.WITH_JOB + (
        "SELECT year, commodity_desc, commodity_class_desc, state_name, CAST(area_planted AS DOUBLE) AS area_planted, "
        "CAST(area_harvested AS DOUBLE) AS area_harvested, CAST(crop_production AS DOUBLE) AS crop_production, "
        "CAST(crop_yield AS DOUBLE) AS crop_yield FROM kc"),
    "residual_full": o.WITH_JOB + f"SELECT {o.RESIDUAL_OUT} FROM unspecified",
    "residual_left": o.WITH_JOB + f"SELECT {o.RESIDUAL_OUT} FROM ({o.residual_sql(with_child_only=False)}) r",
    "tidy_table": o.WITH_JOB + f"SELECT {o.TIDY_OUT} FROM clean_county",
    "tidy_union": o.WITH_JOB + (
        f"SELECT {o.LEVEL_OUT}, CAST(NULL AS VARCHAR) AS county_state_name FROM known_county UNION ALL "
        "SELECT year, NULL, NULL, state_alpha, state_name, county_name, commodity_desc, NULL, commodity_class_desc, "
        "NULL, NULL, production_unit, production_unit_conversion, CAST(production_unit_multiplier AS DOUBLE), "
        "yield_unit, production_to_yield_multiplier, CAST(area_planted AS DOUBLE), CAST(area_harvested AS DOUBLE), "
        f"CAST(crop_production AS DOUBLE), NULL, county_state_name FROM ({o.residual_sql(with_child_only=False)}) r"),
    "yield_trend": o.WITH_JOB + (
        "SELECT year, CAST(SUM(area_harvested) AS DOUBLE) AS harvested, CAST(SUM(area_planted) AS DOUBLE) AS planted, "
        "CAST(SUM(crop_production) AS DOUBLE) AS production, "
        "CAST(SUM(crop_production) AS DOUBLE) / NULLIF(CAST(SUM(area_harvested) AS DOUBLE), 0) AS yield "
        f"FROM clean_county WHERE commodity_name = '{TREND_CROP}' GROUP BY year"),
    "yield_trend_converted": o.WITH_JOB + (
        "SELECT year, CAST(SUM(area_harvested) AS DOUBLE) AS harvested, CAST(SUM(area_planted) AS DOUBLE) AS planted, "
        "CAST(SUM(crop_production) AS DOUBLE) AS production, "
        "CAST(SUM(crop_production * production_unit_multiplier) AS DOUBLE) AS production_bu, "
        "CAST(SUM(crop_production) AS DOUBLE) / NULLIF(CAST(SUM(area_harvested) AS DOUBLE), 0) AS yield, "
        "CAST(SUM(crop_production) * 35.714 AS DOUBLE) AS production_converted "
        f"FROM clean_national WHERE commodity_name = '{CONVERTED_TREND_CROP}' GROUP BY year"),
    "reconcile_levels": o.WITH_JOB + """,
a AS (SELECT year, commodity_name, commodity_class_variety, SUM(area_planted) AS ap, SUM(area_harvested) AS ah,
        SUM(crop_production) AS cp FROM clean_county GROUP BY 1, 2, 3),
b AS (SELECT year, commodity_name, commodity_class_variety, SUM(area_planted) AS ap, SUM(area_harvested) AS ah,
        SUM(crop_production) AS cp FROM clean_national GROUP BY 1, 2, 3)
SELECT COALESCE(a.year, b.year) AS year, COALESCE(a.commodity_name, b.commodity_name) AS commodity_name,
  COALESCE(a.commodity_class_variety, b.commodity_class_variety) AS commodity_class_variety,
  CAST(a.ap AS DOUBLE) AS area_planted_county, CAST(b.ap AS DOUBLE) AS area_planted_national,
  CAST(a.ap - b.ap AS DOUBLE) AS area_planted_diff,
  CAST(a.ah AS DOUBLE) AS area_harvested_county, CAST(b.ah AS DOUBLE) AS area_harvested_national,
  CAST(a.ah - b.ah AS DOUBLE) AS area_harvested_diff,
  CAST(a.cp AS DOUBLE) AS crop_production_county, CAST(b.cp AS DOUBLE) AS crop_production_national,
  CAST(a.cp - b.cp AS DOUBLE) AS crop_production_diff
FROM a FULL JOIN b ON a.year IS NOT DISTINCT FROM b.year AND a.commodity_name IS NOT DISTINCT FROM b.commodity_name
  AND a.commodity_class_variety IS NOT DISTINCT FROM b.commodity_class_variety""",
    "grand_total": o.WITH_LONG + _total_sql("STATE", 3),
    "grand_total_int": o.WITH_LONG + _total_sql("NATIONAL", 0),
    "partition_total": o.WITH_LONG + "SELECT * EXCLUDE (vn) FROM (" + _label_sql("COUNTY", False) + ") y",
    "partition_total_state": o.WITH_LONG + "SELECT * EXCLUDE (vn) FROM (" + _label_sql("STATE", True) + ") y",
    "variety_from_label": o.WITH_LONG + (
        "SELECT short_desc, split_part(short_desc, ' - ', 1) AS commodity_group, "
        "COALESCE(NULLIF(split_part(split_part(short_desc, ' - ', 1), ',', 3), ''), "
        "NULLIF(split_part(split_part(short_desc, ' - ', 1), ',', 2), '')) AS commodity_variety "
        "FROM (SELECT DISTINCT short_desc FROM long) s"),
    "period_profile": o.WITH_LONG + (
        "SELECT freq_desc, reference_period_desc, CAST(SUM(1) AS BIGINT) AS row_count FROM long "
        f"WHERE year >= {MIN_YEAR} AND {o.CROP} GROUP BY 1, 2"),
    "row_count": o.WITH_LONG + "SELECT COUNT(*) AS row_count, CAST(SUM(1) AS BIGINT) AS row_sum FROM long",
    "check_load": o.WITH_LONG + (
        "SELECT COUNT(*) AS row_count, (SELECT COUNT(*) FROM lineitem) AS expected_rows, "
        f"COUNT(*) FILTER (WHERE {_sql_in_all(PROBE)}) AS probe_rows, "
        "COUNT(*) = (SELECT COUNT(*) FROM lineitem) AS rows_match FROM long"),
    "states_present": o.WITH_LONG + "SELECT state_name FROM long GROUP BY 1",
    "null_key_levels": o.WITH_LONG + "SELECT agg_level_desc FROM long WHERE state_name IS NULL GROUP BY 1",
    "names_shared": o.WITH_LONG + ("SELECT county_name, COUNT(DISTINCT state_name) AS state_count FROM long "
                                   "GROUP BY 1"),
    "census_years": o.WITH_LONG + "SELECT year FROM long WHERE source_desc = 'CENSUS' GROUP BY 1",
    "country_profile": o.WITH_LONG + f"SELECT country_name FROM ({_COUNTRY}) c GROUP BY 1",
    "country_rows": o.WITH_LONG + f"SELECT * FROM ({_COUNTRY}) c WHERE country_name <> '{HOME_COUNTRY}'",
    "duplicate_parents": f"WITH {o.LONG},\nraw_{o.CORE},\n" + (
        f"core AS (SELECT * REPLACE (CASE WHEN commodity_desc = 'CORN' AND unit_desc = '$' THEN '{SECOND_CLASS}' "
        f"ELSE class_desc END AS class_desc) FROM raw_core),\nlvl AS ({o.level_sql('STATE')})\n"
        "SELECT year, commodity_desc, commodity_class_desc, state_name, COUNT(*) AS parent_rows FROM lvl "
        "GROUP BY ALL HAVING COUNT(*) > 1"),
    "state_profile": o.WITH_LONG + f""",
scy AS (SELECT state_name, year, commodity_desc, CAST(year AS VARCHAR) || '-' || commodity_desc AS yc FROM long
        WHERE year >= {MIN_YEAR} AND {o.CROP} GROUP BY 1, 2, 3)
SELECT state_name,
  array_to_string(list_transform(list_sort(list_distinct(list(year))), lambda y: CAST(y AS VARCHAR)), ',')
    AS production_years,
  array_to_string(list_sort(list_distinct(list(commodity_desc))), ',') AS commodities_produced,
  string_agg(yc, ',' ORDER BY year, yc) AS commodities_produced_year,
  CAST(len(list_distinct(list(commodity_desc))) AS INTEGER) AS unique_commodities
FROM scy GROUP BY state_name""",
    "numeric_format_profile": o.WITH_LONG + (
        "SELECT CAST(MAX(length(value) - length(replace(value, ',', ''))) AS INTEGER) AS max_place_value, "
        "CAST(MAX(length(NULLIF(regexp_extract(value, '\\d+\\.(\\d+)', 1), ''))) AS INTEGER) AS max_decimal_places "
        "FROM long"),
    "unit_inventory": o.WITH_LONG + (
        f"SELECT statisticcat_desc, unit_desc, commodity_desc FROM long WHERE {o.CROP} "
        f"AND statisticcat_desc IN {o.STATS} AND source_desc = 'SURVEY' GROUP BY 1, 2, 3"),
    "distinct_combos": o.WITH_LONG + (
        "SELECT state_name, source_desc, statisticcat_desc, commodity_desc, unit_desc, value FROM long "
        f"WHERE state_name IN ('{SPARSE_STATES[0]}', '{SPARSE_STATES[1]}') AND {o.CROP} AND source_desc = 'SURVEY' "
        "GROUP BY 1, 2, 3, 4, 5, 6"),
    "ordered_profile": o.WITH_LONG + "SELECT state_name, CAST(SUM(1) AS BIGINT) AS row_count FROM long GROUP BY 1",
    "scan_delimited": o.WITH_LONG + _BACKSLASHED,
    "scan_header_like_rows": o.WITH_LONG + _HEADER_ROWS,
    "scan_mixed_headers": o.WITH_LONG + _HEADER_ROWS,
    "scan_trim": o.WITH_LONG + "SELECT * FROM long",
    "scan_escaped": o.WITH_LONG + (
        "SELECT * REPLACE (replace(short_desc, ' - ', chr(9) || '- \\') AS short_desc, "
        "replace(county_name, 'COUNTY-', '#COUNTY' || chr(10)) AS county_name) FROM long"),
    "scan_utf8": o.WITH_LONG + "SELECT * FROM long WHERE agg_level_desc <> 'NATIONAL'",
    "scan_quarantine": o.WITH_LONG + ("SELECT * FROM long WHERE agg_level_desc NOT IN ('WATERSHED', 'NATIONAL') "
                                      "AND prodn_practice_desc <> 'IRRIGATED'"),
    "scan_rejects": o.WITH_LONG + (
        "SELECT CASE agg_level_desc WHEN 'WATERSHED' THEN 'field_count' WHEN 'NATIONAL' THEN 'invalid_utf8' "
        "ELSE 'bad_value' END AS reason, COUNT(*) AS row_count FROM long "
        "WHERE agg_level_desc IN ('WATERSHED', 'NATIONAL') OR prodn_practice_desc = 'IRRIGATED' GROUP BY 1"),
    "export_tsv": o.WITH_JOB + f"SELECT {o.TIDY_OUT} FROM clean_county",
    "export_manifest": o.WITH_JOB + ("SELECT TRUE AS has_files, TRUE AS all_hold_bytes, COUNT(*) AS exported_rows "
                                     "FROM clean_county"),
    "export_check": o.WITH_JOB + ("SELECT COUNT(*) AS exported_rows, COUNT(*) AS table_rows, TRUE AS rows_match "
                                  "FROM clean_county"),
    "layout_write": o.WITH_LONG + "SELECT * FROM long",
    "layout_tidy": o.WITH_JOB + f"SELECT {o.TIDY_OUT} FROM clean_county",
    "stream_landing": o.WITH_LONG + _BACKSLASHED,
    "scan_dimension": o.WITH_LONG + (
        "SELECT state_fips_code || county_code AS fipstxt, state_alpha AS state, county_name AS county, "
        "CAST(COUNT(*) AS DOUBLE) AS ruralurbancontinuumcode2013, "
        "CAST(COUNT(DISTINCT year) AS DOUBLE) AS urbaninfluencecode2013, "
        + ", ".join(f"CAST(COUNT(*) * {k} + COUNT(DISTINCT year) AS DOUBLE) AS {f.name}"
                    for k, f in enumerate(DIMENSION_SCHEMA.fields[5:], 2))
        + " FROM long WHERE agg_level_desc = 'COUNTY' GROUP BY 1, 2, 3"),
    "load_table": o.WITH_LONG + "SELECT * FROM long",
}
ORACLES.update(analysis.ORACLES)
