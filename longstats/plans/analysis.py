"""Registered queries over loads, totals and series: what the survey's scripts do by hand or not at all.

Reload of single years, differences of two loads, totals at every level, ordered figures and tops, lookups in the
county dimension and in value bands, stored column sketches.  Each reads the driver tables through the derived long view and has a DuckDB statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longstats.functions.numbers import parse_grouped_decimal
from longstats.functions.text import county_id
from longstats.operators.asof import asof_join
from longstats.operators.bands import band_join
from longstats.operators.dimension import dimension_versions, join_dimension, match_summary
from longstats.operators.residual import reconcile_gate, reconcile_levels
from longstats.operators.series import change_on_previous, moving_ratio, ranked, running_total, top_per_group
from longstats.operators.sketches import column_sketches, merge_sketches, sketch_report
from longstats.operators.snapshot import changed_groups, except_all, expand, intersect_all, snapshot_diff, snapshot_summary
from longstats.operators.totals import cube_sets, level_totals
from longstats.operators.trends import unit_yield_trend
from longstats.plans import oracle_sql as o
from longstats.plans.base import MIN_YEAR, Query, _job, _long, comparable, county_dimension
from longstats.plans.job import refresh_job, run_job
from longstats.schemas import LONG_COLUMNS, LONG_SCHEMA, RAW_COLUMNS, TIDY_COLUMNS
from longstats.session import materialize, scratch_path
from longstats.sources.export import ROWS_PER_FILE, export_delimited
from longstats.sources.layout import write_table
from longstats.sources.reload import reload_years, table_files
from longstats.streaming.rollup import StreamReport, rollup_stream

#: The year that a later drop brings again, and one that a drop withdraws.
RELOADED, WITHDRAWN = 1998, 1999


def _drop(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    export_delimited(df, path)
    return path


# ----------------------------------------------------------------- partial reload

def _outdated(long: DataFrame) -> DataFrame:
    """The long rows as an earlier load had them: the reloaded year suppressed and without one state."""
    old = F.col("year") == RELOADED
    return (long.filter(~(old & F.col("state_name").eqNullSafe("NATION_3")))
            .withColumn("value", F.when(old, "(D)").otherwise(F.col("value"))))


def _outdated_table(spark, sf) -> tuple[DataFrame, str]:
    long, target = _long(spark, sf), scratch_path(spark, "reload-table")
    write_table(_outdated(long), target)
    return long, target


def q_reload_year(spark, sf):
    """An outdated table after the reload of one year: the long table."""
    long, target = _outdated_table(spark, sf)
    return reload_years(spark, _drop(long.filter(F.col("year") == RELOADED), "reload-drop"), target, LONG_SCHEMA, [RELOADED])


def q_reload_withdrawn(spark, sf):
    """A drop for two years that has rows of one only: the other year goes."""
    long, target = _outdated_table(spark, sf)
    return reload_years(spark, _drop(long.filter(F.col("year") == RELOADED), "reload-drop"), target, LONG_SCHEMA, [RELOADED, WITHDRAWN])


def q_reload_files(spark, sf):
    """Per year whether a reload of one year kept all its files."""
    long, target = _outdated_table(spark, sf)
    old = materialize(table_files(spark, target), "files-before").alias("b")
    reload_years(spark, _drop(long.filter(F.col("year") == RELOADED), "reload-drop"), target, LONG_SCHEMA, [RELOADED])
    new = table_files(spark, target).alias("a")
    return (old.join(new, ["path"], "left").groupBy(F.col("b.year").cast("int").alias("year"))
            .agg(F.bool_and(F.col("a.year").isNotNull()).alias("kept")))


def q_refresh_tidy(spark, sf):
    """The tidy table after a reload of one year: only that year is built again."""
    long, output = _long(spark, sf), scratch_path(spark, "refreshed-job")
    lacking = sorted({c.lower() for c in RAW_COLUMNS} - set(LONG_COLUMNS))

    def drops(rows: DataFrame) -> str:
        wide = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in lacking])
        return _drop(wide.select(*[c.lower() for c in RAW_COLUMNS]), "raw-drop")

    run_job(spark, drops(_outdated(long)), output, min_year=MIN_YEAR)
    done = refresh_job(spark, drops(long.filter(F.col("year") == RELOADED)), output, [RELOADED], min_year=MIN_YEAR)
    return comparable(spark.read.parquet(done.outputs.clean_county).select(*TIDY_COLUMNS))


# ----------------------------------------------------------------- differences of two loads

def _earlier(long: DataFrame) -> DataFrame:
    """An earlier load: one state's year lacks, rice of a year is suppressed, watershed rows of a year stand twice."""
    lacks = F.col("state_name").eqNullSafe("NATION_7") & (F.col("year") == 1997)
    rice = (F.col("commodity_desc") == "RICE") & (F.col("year") == 1998)
    twice = long.filter((F.col("agg_level_desc") == "WATERSHED") & (F.col("year") == 1996))
    return long.filter(~lacks).withColumn("value", F.when(rice, "(D)").otherwise(F.col("value"))).unionByName(twice)


SNAPSHOT_KEYS = [c for c in LONG_COLUMNS if c != "value"]


def q_snapshot_diff(spark, sf):
    long = _long(spark, sf)
    return snapshot_diff(_earlier(long), long, keys=SNAPSHOT_KEYS)


def q_snapshot_added(spark, sf):
    long = _long(spark, sf)
    return expand(except_all(long, _earlier(long)))


def q_snapshot_kept(spark, sf):
    long = _long(spark, sf)
    return expand(intersect_all(_earlier(long), long))


def q_snapshot_summary(spark, sf):
    long = _long(spark, sf)
    return snapshot_summary(_earlier(long), long, ["year", "agg_level_desc"])


def q_changed_years(spark, sf):
    long = _long(spark, sf)
    return changed_groups(_earlier(long), long, ["year"])


# ----------------------------------------------------------------- totals at every level

TOTAL_LEVELS = {
    "county": ["year", "commodity_name", "state_name", "county_name"], "state": ["year", "commodity_name", "state_name"],
    "nation": ["year", "commodity_name"], "crop": ["commodity_name"], "all": [],
}
CUBE_KEYS = ["source_desc", "state_alpha", "agg_level_desc"]


def q_level_totals(spark, sf):
    return comparable(level_totals(_job(spark, sf).tidy, TOTAL_LEVELS, sums=["area_harvested", "crop_production"], averages=["crop_yield"]))


def q_source_cube(spark, sf):
    return level_totals(_long(spark, sf), cube_sets(CUBE_KEYS), least=["year"], greatest=["year"])


# ----------------------------------------------------------------- series

def q_year_on_year(spark, sf):
    return comparable(change_on_previous(_job(spark, sf).tidy, ["state_name", "commodity_name"], "crop_production"))


def q_moving_yield(spark, sf):
    return comparable(moving_ratio(_job(spark, sf).tidy, ["state_name", "commodity_name"], "crop_production", "area_harvested", "yield"))


def q_running_area(spark, sf):
    return comparable(running_total(_job(spark, sf).levels.known_county, ["commodity_name"], "fips_county_code", "area_harvested"))


def _county_areas(spark, sf) -> DataFrame:
    return (_job(spark, sf).levels.known_county.groupBy("year", "commodity_name", "fips_county_code")
            .agg(F.sum("area_harvested").alias("area_harvested")))


def q_county_ranks(spark, sf):
    return comparable(ranked(_county_areas(spark, sf), ["year", "commodity_name"], "area_harvested"))


def q_top_counties(spark, sf):
    """The three largest counties of each crop and year, ties included."""
    return comparable(top_per_group(_county_areas(spark, sf), ["year", "commodity_name"], [F.col("area_harvested").desc_nulls_last()], 3))


def q_top_crops(spark, sf):
    """The crop with the most rows of each state and year; ties go to the name."""
    rows = _long(spark, sf).groupBy("state_name", "year", "commodity_desc").agg(F.count(F.lit(1)).alias("row_count"))
    return top_per_group(rows, ["state_name", "year"], [F.col("row_count").desc(), F.col("commodity_desc")], 1, ties=False).drop("place")


def q_unit_yield(spark, sf):
    """Yields of all crops in their own units."""
    return comparable(unit_yield_trend(_job(spark, sf).tidy))


# ----------------------------------------------------------------- reconciliation as a gate

GATE_KEYS = ["year", "commodity_name", "commodity_class_variety"]
GATE_MEASURES = ["area_planted", "area_harvested", "crop_production"]
TOLERANCE = 0.5


def q_reconcile_failures(spark, sf):
    """Figures of counties and nation that differ by more than half of the nation's, or that one side lacks."""
    job, names = _job(spark, sf), ("county", "national")
    report = reconcile_levels(job.tidy, job.levels.clean_national, GATE_KEYS, GATE_MEASURES, names)
    return comparable(reconcile_gate(report, GATE_KEYS, GATE_MEASURES, names, TOLERANCE))


# ----------------------------------------------------------------- lookups

#: The editions of the dimension's codes, and the fixture's years from which they hold.
EDITIONS = {2003: 1996, 2013: 1999}
CODES = {"rural_urban": "ruralurbancontinuumcode", "urban_influence": "urbaninfluencecode"}


def _located(spark, sf) -> DataFrame:
    return _long(spark, sf).select(county_id().alias("fipstxt"), "agg_level_desc", "year", "commodity_desc", "statisticcat_desc", "value")


def _known_counties(spark, sf) -> DataFrame:
    """The county dimension without the combined counties."""
    return county_dimension(_long(spark, sf)).filter(~F.col("fipstxt").endswith("4"))


def q_asof_codes(spark, sf):
    """Every long row with the county codes of the edition that held in its year."""
    versions = dimension_versions(county_dimension(_long(spark, sf)), "fipstxt", CODES, EDITIONS)
    return asof_join(_located(spark, sf), versions, ["fipstxt"], "year", "code_year", list(CODES))


def q_dimension_join(spark, sf):
    return join_dimension(_located(spark, sf).withColumnRenamed("fipstxt", "fips"), _known_counties(spark, sf), "fips", "fipstxt", ["metro2013"])


def q_dimension_match(spark, sf):
    return match_summary(_located(spark, sf).withColumnRenamed("fipstxt", "fips"), _known_counties(spark, sf), "fips", "fipstxt",
                         by=["agg_level_desc"])


def q_value_bands(spark, sf):
    """Rows per crop whose value lies in the suppliers' bands, whose widths are 1 to 2401."""
    rows = _long(spark, sf).select("commodity_desc", parse_grouped_decimal("value").cast("double").alias("number"))
    bands = spark.read.parquet(f"{sf}/supplier.parquet").select(
        "s_suppkey", F.col("s_acctbal").cast("double").alias("low"),
        (F.col("s_acctbal").cast("double") + F.pow(F.col("s_suppkey") % 7 + 1, F.lit(4))).alias("high"))
    return (band_join(rows, bands, "number", "low", "high", by=["commodity_desc"]).groupBy("s_suppkey", "commodity_desc")
            .agg(F.sum("row_count").alias("row_count"), F.min("least").alias("least"), F.max("greatest").alias("greatest")))


# ----------------------------------------------------------------- stored sketches

SKETCHED = ["state_name", "county_name", "commodity_desc", "unit_desc", "value"]


def q_column_profile(spark, sf):
    """The profile of all years merged from one per year; distinct counts within 5 % of the exact ones."""
    long = _long(spark, sf)
    merged = sketch_report(merge_sketches(column_sketches(long, SKETCHED, by=["year"])))
    exact = long.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in SKETCHED])))
    return merged.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "least", "greatest",
        (F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_close"))


# ----------------------------------------------------------------- the streamed roll-up

STREAM_KEYS = ["year", "agg_level_desc", "state_name", "commodity_desc", "statisticcat_desc"]
STREAM_DELAY = "1000 days"


def _append_drop(df: DataFrame, path: str) -> None:
    (df.write.mode("append").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "")
     .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))


def _streamed(spark, sf) -> tuple[DataFrame, list[StreamReport]]:
    """The table and the reports of three runs: all rows from MIN_YEAR on, the same drop again, and the years before."""
    long, base = _long(spark, sf), scratch_path(spark, "stream-rollup")
    current = long.filter(F.col("year") >= MIN_YEAR)
    totals = {"row_count": F.count(F.lit(1)), "total": F.sum(parse_grouped_decimal("value"))}
    time = F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    reports = []
    for drop in (current, current, long.filter(F.col("year") < MIN_YEAR)):
        _append_drop(drop, f"{base}/drops")
        reports.append(rollup_stream(spark, f"{base}/drops", LONG_SCHEMA, f"{base}/table", f"{base}/checkpoint", STREAM_KEYS,
                                     totals, time, STREAM_DELAY))
    return spark.read.parquet(f"{base}/table").select(*STREAM_KEYS, *totals), reports


def q_stream_rollup(spark, sf):
    """Totals of the distinct rows, however often their drop came; years that came too late are not in it."""
    return comparable(_streamed(spark, sf)[0])


def q_stream_report(spark, sf):
    """What the three runs left out."""
    reports = _streamed(spark, sf)[1]
    return spark.createDataFrame([(i, r.input_rows, r.late_rows, r.repeated_rows) for i, r in enumerate(reports, 1)],
                                 "run int, input_rows long, late_rows long, repeated_rows long")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

# ----------------------------------------------------------------- oracles

_ALL = ", ".join(LONG_COLUMNS)
_KEYS = ", ".join(SNAPSHOT_KEYS)
_LOADS = f"""WITH {o.LONG},
earlier AS (
  SELECT * REPLACE (CASE WHEN commodity_desc = 'RICE' AND year = 1998 THEN '(D)' ELSE value END AS value) FROM long
  WHERE state_name IS DISTINCT FROM 'NATION_7' OR year <> 1997
  UNION ALL
  SELECT * FROM long WHERE agg_level_desc = 'WATERSHED' AND year = 1996),
counted AS (
  SELECT {_ALL}, sum(o) AS o, sum(n) AS n
  FROM (SELECT *, 1 AS o, 0 AS n FROM earlier UNION ALL SELECT *, 0, 1 FROM long) GROUP BY {_ALL})
"""
_SETS = ", ".join(f"({', '.join(s)})" for s in TOTAL_LEVELS.values())
_AREAS = "areas AS (SELECT year, commodity_name, fips_county_code, SUM(area_harvested) AS area FROM known_county GROUP BY 1, 2, 3)"

_LOCATED = ("SELECT state_fips_code || county_code AS fipstxt, agg_level_desc, year, commodity_desc, statisticcat_desc, value "
            "FROM long")
_DIMENSION = ("dim AS (SELECT state_fips_code || county_code AS fipstxt, COUNT(*) AS n, COUNT(DISTINCT year) AS y FROM long "
              "WHERE agg_level_desc = 'COUNTY' GROUP BY 1)")
_MATCH = "CASE WHEN l.fipstxt IS NULL THEN 'null_key' WHEN d.fipstxt IS NULL THEN 'unmatched' ELSE 'matched' END"

ORACLES: dict[str, str] = {
    "reload_year": o.WITH_LONG + "SELECT * FROM long",
    "reload_withdrawn": o.WITH_LONG + f"SELECT * FROM long WHERE year <> {WITHDRAWN}",
    "reload_files": o.WITH_LONG + f"SELECT year, year <> {RELOADED} AS kept FROM long GROUP BY year",
    "refresh_tidy": o.WITH_JOB + f"SELECT {o.TIDY_OUT} FROM clean_county",
    "snapshot_diff": _LOADS + f"""
SELECT CASE WHEN n > o AND bool_or(n < o) OVER same THEN 'after' WHEN n > o THEN 'added'
            WHEN bool_or(n > o) OVER same THEN 'before' ELSE 'removed' END AS change,
       CAST(abs(n - o) AS BIGINT) AS copies, {_ALL}
FROM counted WHERE n <> o WINDOW same AS (PARTITION BY {_KEYS})""",
    "snapshot_added": _LOADS + "SELECT * FROM long EXCEPT ALL SELECT * FROM earlier",
    "snapshot_kept": _LOADS + "SELECT * FROM earlier INTERSECT ALL SELECT * FROM long",
    "snapshot_summary": _LOADS + (
        "SELECT year, agg_level_desc, CAST(sum(o) AS BIGINT) AS old_rows, CAST(sum(n) AS BIGINT) AS new_rows, "
        "CAST(sum(least(o, n)) AS BIGINT) AS kept, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, "
        "CAST(sum(greatest(o - n, 0)) AS BIGINT) AS removed FROM counted GROUP BY 1, 2"),
    "changed_years": _LOADS + "SELECT DISTINCT year FROM counted WHERE n <> o",
    "level_totals": o.WITH_JOB + f"""
SELECT CASE level_id WHEN 0 THEN 'county' WHEN 1 THEN 'state' WHEN 3 THEN 'nation' WHEN 11 THEN 'crop' ELSE 'all' END AS level, *
FROM (SELECT CAST(GROUPING(year, commodity_name, state_name, county_name) AS BIGINT) AS level_id, year, commodity_name,
        state_name, county_name, COUNT(*) AS row_count, CAST(SUM(area_harvested) AS DOUBLE) AS area_harvested,
        CAST(SUM(crop_production) AS DOUBLE) AS crop_production,
        CAST(SUM(crop_yield) AS DOUBLE) / NULLIF(COUNT(crop_yield), 0) AS average_crop_yield
      FROM clean_county GROUP BY GROUPING SETS ({_SETS})) t""",
    "source_cube": o.WITH_LONG + """
SELECT array_to_string(list_filter([CASE WHEN GROUPING(source_desc) = 0 THEN 'source_desc' END,
         CASE WHEN GROUPING(state_alpha) = 0 THEN 'state_alpha' END,
         CASE WHEN GROUPING(agg_level_desc) = 0 THEN 'agg_level_desc' END], lambda x: x IS NOT NULL), ',')
         || CASE WHEN GROUPING(source_desc, state_alpha, agg_level_desc) = 7 THEN 'all' ELSE '' END AS level,
       CAST(GROUPING(source_desc, state_alpha, agg_level_desc) AS BIGINT) AS level_id, source_desc, state_alpha, agg_level_desc,
       COUNT(*) AS row_count, MIN(year) AS least_year, MAX(year) AS greatest_year
FROM long GROUP BY CUBE (source_desc, state_alpha, agg_level_desc)""",
    "year_on_year": o.WITH_JOB + """
SELECT state_name, commodity_name, year, CAST(v AS DOUBLE) AS crop_production, CAST(p AS DOUBLE) AS previous,
       CAST(v - p AS DOUBLE) AS change, CAST(v - p AS DOUBLE) / NULLIF(CAST(p AS DOUBLE), 0) AS change_ratio
FROM (SELECT *, SUM(v) OVER (PARTITION BY state_name, commodity_name ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p
      FROM (SELECT state_name, commodity_name, year, SUM(crop_production) AS v FROM clean_county GROUP BY 1, 2, 3))""",
    "moving_yield": o.WITH_JOB + """
SELECT state_name, commodity_name, year, CAST(c AS DOUBLE) AS crop_production, CAST(a AS DOUBLE) AS area_harvested, periods,
       CAST(c AS DOUBLE) / NULLIF(CAST(a AS DOUBLE), 0) AS yield
FROM (SELECT state_name, commodity_name, year, SUM(c) OVER w AS c, SUM(a) OVER w AS a, COUNT(*) OVER w AS periods
      FROM (SELECT state_name, commodity_name, year, SUM(crop_production) AS c, SUM(area_harvested) AS a FROM clean_county GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY state_name, commodity_name ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "running_area": o.WITH_JOB + """
SELECT commodity_name, fips_county_code, CAST(v AS DOUBLE) AS area_harvested,
       CAST(SUM(v) OVER (PARTITION BY commodity_name ORDER BY fips_county_code NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_area_harvested
FROM (SELECT commodity_name, fips_county_code, SUM(area_harvested) AS v FROM known_county GROUP BY 1, 2)""",
    "county_ranks": o.WITH_JOB + f""", {_AREAS}
SELECT year, commodity_name, fips_county_code, CAST(area AS DOUBLE) AS area_harvested, RANK() OVER w AS place, DENSE_RANK() OVER w AS place_dense
FROM areas WINDOW w AS (PARTITION BY year, commodity_name ORDER BY area DESC NULLS LAST)""",
    "top_counties": o.WITH_JOB + f""", {_AREAS}
SELECT year, commodity_name, fips_county_code, CAST(area AS DOUBLE) AS area_harvested,
       CAST(RANK() OVER (PARTITION BY year, commodity_name ORDER BY area DESC NULLS LAST) AS INTEGER) AS place
FROM areas QUALIFY place <= 3""",
    "unit_yield": o.WITH_JOB + """
SELECT year, commodity_name, yield_unit, CAST(h AS DOUBLE) AS harvested, CAST(p AS DOUBLE) AS production,
       CAST(p AS DOUBLE) * production_to_yield_multiplier AS production_in_yield_unit,
       CAST(p AS DOUBLE) * production_to_yield_multiplier / NULLIF(CAST(h AS DOUBLE), 0) AS yield
FROM (SELECT year, commodity_name, yield_unit, production_to_yield_multiplier, SUM(area_harvested) AS h, SUM(crop_production) AS p
      FROM clean_county GROUP BY ALL) u""",
    "reconcile_failures": o.WITH_JOB + """,
sides AS (
  SELECT year, commodity_name, commodity_class_variety, measure, SUM(c) AS c, SUM(n) AS n
  FROM (SELECT year, commodity_name, commodity_class_variety, unnest(['area_planted', 'area_harvested', 'crop_production']) AS measure,
               unnest([area_planted, area_harvested, crop_production]) AS c, NULL::DECIMAL(38,3) AS n FROM clean_county
        UNION ALL
        SELECT year, commodity_name, commodity_class_variety, unnest(['area_planted', 'area_harvested', 'crop_production']),
               NULL, unnest([area_planted, area_harvested, crop_production]) FROM clean_national) x
  GROUP BY ALL)
SELECT year, commodity_name, commodity_class_variety, measure, CAST(c AS DOUBLE) AS county, CAST(n AS DOUBLE) AS national,
       CAST(c - n AS DOUBLE) AS diff,
       CASE WHEN c IS NULL THEN 'missing_county' WHEN n IS NULL THEN 'missing_national' WHEN c > n THEN 'over' ELSE 'under' END AS reason
FROM sides WHERE (c IS NULL) <> (n IS NULL) OR abs(CAST(c - n AS DOUBLE)) > abs(CAST(n AS DOUBLE)) * 0.5""",
    "top_crops": o.WITH_LONG + """
SELECT * FROM (SELECT state_name, year, commodity_desc, COUNT(*) AS row_count FROM long GROUP BY ALL) c
QUALIFY ROW_NUMBER() OVER (PARTITION BY state_name, year ORDER BY row_count DESC, commodity_desc) = 1""",
    "stream_rollup": o.WITH_LONG + f"""
SELECT {', '.join(STREAM_KEYS)}, COUNT(*) AS row_count, CAST(SUM({o.num('value')}) AS DOUBLE) AS total
FROM (SELECT DISTINCT * FROM long WHERE year >= {MIN_YEAR}) d GROUP BY ALL""",
    "stream_report": o.WITH_LONG + f""",
now AS (SELECT *, make_date(year, 1, 1) <= (SELECT make_date(MAX(year), 1, 1) - INTERVAL 1000 DAY FROM long) AS late
        FROM long WHERE year >= {MIN_YEAR})
SELECT 1 AS run, COUNT(*) AS input_rows, CAST(0 AS BIGINT) AS late_rows,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM now)) AS repeated_rows FROM now
UNION ALL SELECT 2, COUNT(*), COUNT(*) FILTER (WHERE late), COUNT(*) FILTER (WHERE NOT late) FROM now
UNION ALL SELECT 3, COUNT(*), COUNT(*), 0 FROM long WHERE year < {MIN_YEAR}""",
    "asof_codes": o.WITH_LONG + f""", {_DIMENSION},
versions AS (SELECT fipstxt, 1996 AS code_year, n * 2 + y AS rural_urban, n * 3 + y AS urban_influence FROM dim
             UNION ALL SELECT fipstxt, 1999, n, y FROM dim)
SELECT l.*, v.code_year, CAST(v.rural_urban AS DOUBLE) AS rural_urban, CAST(v.urban_influence AS DOUBLE) AS urban_influence
FROM ({_LOCATED}) l ASOF LEFT JOIN versions v ON l.fipstxt = v.fipstxt AND l.year >= v.code_year""",
    "dimension_join": o.WITH_LONG + f""", {_DIMENSION}
SELECT l.fipstxt AS fips, agg_level_desc, year, commodity_desc, statisticcat_desc, value, CAST(d.n * 4 + d.y AS DOUBLE) AS metro2013,
       {_MATCH} AS match
FROM ({_LOCATED}) l LEFT JOIN (SELECT * FROM dim WHERE NOT ends_with(fipstxt, '4')) d ON l.fipstxt = d.fipstxt""",
    "dimension_match": o.WITH_LONG + f""", {_DIMENSION}
SELECT agg_level_desc, {_MATCH} AS match, COUNT(*) AS row_count, COUNT(DISTINCT l.fipstxt) AS key_count
FROM ({_LOCATED}) l LEFT JOIN (SELECT * FROM dim WHERE NOT ends_with(fipstxt, '4')) d ON l.fipstxt = d.fipstxt GROUP BY 1, 2""",
    "value_bands": o.WITH_LONG + f"""
SELECT s_suppkey, commodity_desc, COUNT(*) AS row_count, MIN(number) AS least, MAX(number) AS greatest
FROM (SELECT commodity_desc, CAST({o.num('value')} AS DOUBLE) AS number FROM long) l
JOIN (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS low, CAST(s_acctbal AS DOUBLE) + pow(s_suppkey % 7 + 1, 4) AS high FROM supplier) b
  ON low <= number AND number < high GROUP BY 1, 2""",
    "column_profile": o.WITH_LONG + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, MIN({c}) AS least, "
        f"MAX({c}) AS greatest, TRUE AS distinct_close FROM long" for c in SKETCHED),
}
