"""Level roll-ups: known counties, state and national tables.

One parameterised operator replaces the reference's three copies of the same
126-line projection.  The redundant-total list (anti join) and the known-class
list (semi join) are aggregates bounded by the distinct (commodity, class)
pairs.  The job writes them first: the planner then knows their exact size and
broadcasts them if it is under the broadcast threshold (a sort-merge join
otherwise), before any row of the large side is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longstats.functions.numbers import parse_grouped_decimal, year_date
from longstats.functions.text import county_id, title_case
from longstats.operators.pivot import conditional_pivot
from longstats.operators.scope import effective_class, level_scope
from longstats.operators.units import rollup_measures, unit_columns

# Fixed values of the reference job.
ALL_CLASSES = "ALL CLASSES"
LEVELS = ("COUNTY", "STATE", "NATIONAL")

# Group keys of a roll-up.  The reference groups by 11 columns; three of them
# (calendar date, commodity name, class variety) are functions of these and are
# derived after aggregation.
ROLLUP_KEYS = ["year", "fips_county_code", "state_alpha", "state_name", "county_name",
               "commodity_desc", "commodity_class_desc", "class_desc"]

LEVEL_COLUMNS = [
    "year", "calendar_date", "fips_county_code", "state_alpha", "state_name", "county_name",
    "commodity_desc", "commodity_name", "commodity_class_desc", "commodity_class_variety",
    "class_desc", "production_unit", "production_unit_conversion", "production_unit_multiplier",
    "yield_unit", "production_to_yield_multiplier", "area_planted", "area_harvested",
    "crop_production", "crop_yield",
]


def varied_commodities(core: DataFrame, level: str = "COUNTY", exempt: Iterable[str] = ("CORN",),
                       total: str = ALL_CLASSES, min_distinct: int = 2) -> DataFrame:
    """(commodity, total) for each commodity reporting at least ``min_distinct``
    classes at ``level``: its ``total`` rows double count its classes.

    Built over all rows of ``level`` (any source, practice or period).
    ``count_distinct`` is planned as two aggregations, the first keyed by
    (commodity, class), so a hot commodity is combined map-side.
    """
    rows = core.filter((F.col("agg_level_desc") == level) & ~F.col("commodity_desc").isin(list(exempt)))
    return (rows.groupBy("commodity_desc")
            .agg(F.count_distinct("class_desc").alias("class_count"))
            .filter(F.col("class_count") >= min_distinct)
            .select("commodity_desc", F.lit(total).alias("class_desc")))


def drop_redundant_totals(df: DataFrame, redundant: DataFrame,
                          on: Sequence[str] = ("commodity_desc", "class_desc")) -> DataFrame:
    """Anti join: drop rows whose (commodity, class) is a redundant total.
    Rows with a NULL key never match and are kept (NOT EXISTS semantics)."""
    return df.join(redundant.select(*on), list(on), "left_anti").select(*df.columns)


def known_classes(df: DataFrame, on: Sequence[str] = ("commodity_desc", "class_desc")) -> DataFrame:
    """The distinct (commodity, class) pairs of ``df``."""
    return df.select(*on).distinct()


def keep_known_classes(df: DataFrame, known: DataFrame,
                       on: Sequence[str] = ("commodity_desc", "class_desc")) -> DataFrame:
    """Semi join: keep rows whose raw (commodity, class) occurs in ``known``
    (a class list: materialise it first where ``df`` is large).
    NULL keys never match and are dropped (EXISTS semantics)."""
    return df.join(known.select(*on), list(on), "left_semi").select(*df.columns)


def _keyed(scoped: DataFrame) -> DataFrame:
    return scoped.select(
        "agg_level_desc", "year", county_id().alias("fips_county_code"), "state_alpha",
        "state_name", "county_name", "commodity_desc",
        effective_class().alias("commodity_class_desc"), "class_desc", "statisticcat_desc",
        "unit_desc", parse_grouped_decimal("value", 38, 3).alias("num"))


def decorate(agg: DataFrame, keep_level: bool = False) -> DataFrame:
    """Derive date, display names and unit columns on aggregated rows; order columns."""
    derived = {
        "calendar_date": year_date("year"),
        "commodity_name": title_case("commodity_desc"),
        "commodity_class_variety": title_case("commodity_class_desc"),
        **unit_columns("commodity_desc", "commodity_class_desc"),
    }
    # names that the rows already carry stay as they are (and stay plain columns for filters)
    out = agg.withColumns({name: c for name, c in derived.items() if name not in agg.columns})
    cols = (["agg_level_desc"] if keep_level else []) + LEVEL_COLUMNS
    return out.select(*cols)


def with_display_names(agg: DataFrame) -> DataFrame:
    """The two display names that consumers filter on."""
    return agg.withColumns({"commodity_name": title_case("commodity_desc"),
                            "commodity_class_variety": title_case("commodity_class_desc")})


def rollup(core: DataFrame, levels: str | Iterable[str] = LEVELS, decorated: bool = True) -> DataFrame:
    """Pivot survey rows of one or more levels into the four measures, grouped by
    level and the roll-up keys, in one scan and one shuffle.

    ``decorated=False`` returns only the keys and measures.  The derived columns
    use ``transform`` (no generated code), so adding them directly above the
    aggregate takes the final aggregation out of whole-stage codegen; derive
    them later, where they are needed, with ``decorate``.
    """
    levels = [levels] if isinstance(levels, str) else list(levels)
    keyed = _keyed(level_scope(core, levels))
    agg = conditional_pivot(keyed, ["agg_level_desc", *ROLLUP_KEYS], rollup_measures(F.col("num")))
    return decorate(agg, keep_level=True) if decorated else agg


def rollup_level(core: DataFrame, level: str) -> DataFrame:
    """Roll-up of a single level, without class filtering (20 columns)."""
    return rollup(core, level).drop("agg_level_desc")


@dataclass
class LevelTables:
    known_county: DataFrame
    clean_state: DataFrame
    clean_national: DataFrame
    #: The class lists that the tables were filtered by (redundant totals, known classes).
    redundant: DataFrame | None = None
    known: DataFrame | None = None


def clean_levels(core: DataFrame, materialize: bool = True, root: str | None = None,
                 redundant: DataFrame | None = None, known_elsewhere: DataFrame | None = None) -> LevelTables:
    """known_county, clean_state and clean_national from one roll-up pass.

    Commodity and class are group keys, so the class filters keep or drop whole
    groups and may run on either side of the aggregation.  The redundant-total
    anti join is on (level, commodity, class) with the list tagged COUNTY, so
    state and national rows never match it.  With ``materialize`` three tables
    are written (to the shared checkpoint folder, or under ``root``): the
    redundant totals and the known classes, both bounded by the distinct
    (commodity, class) pairs, and the roll-up, which all consumers read.  Because the
    lists' sizes are known before the joins are planned, neither join shuffles
    its large side while the list is under the broadcast threshold.  The roll-up
    holds keys, measures and the two display names, sorted by year, so a
    filter on a name or a year reaches the files; dates and units are derived on read (and pruned by
    consumers that do not use them).  Without ``materialize`` Catalyst pushes
    each level filter below the aggregate: one scan per level, lists recomputed.

    Where ``core`` holds some years only, both lists still follow all years: give the list of redundant totals,
    and the (commodity, class) pairs that are known from the other years.
    """
    from longstats.session import materialize as write_back
    if redundant is None:
        redundant = varied_commodities(core)
        if materialize:
            redundant = write_back(redundant, "redundant_totals", root=root)
    at_county = redundant.select("commodity_desc", "class_desc", F.lit("COUNTY").alias("agg_level_desc"))
    kept = with_display_names(drop_redundant_totals(rollup(core, LEVELS, decorated=False), at_county,
                                                    on=("agg_level_desc", "commodity_desc", "class_desc")))
    if materialize:
        # partitioned by level: every consumer's level filter prunes directories
        kept = write_back(kept.sortWithinPartitions("agg_level_desc", "year", "commodity_desc"), "rollup_levels",
                          partition_by=("agg_level_desc",), root=root)
    known = known_classes(kept.filter(F.col("agg_level_desc") == "COUNTY"))
    if known_elsewhere is not None:
        known = known.union(known_elsewhere.select(*known.columns)).distinct()
    if materialize:
        known = write_back(known, "known_classes", root=root)
    # derived columns on read: a consumer that does not select them never computes them
    kept = decorate(kept, keep_level=True)
    by_level = {lvl: kept.filter(F.col("agg_level_desc") == lvl).drop("agg_level_desc") for lvl in LEVELS}
    return LevelTables(
        known_county=by_level["COUNTY"],
        clean_state=keep_known_classes(by_level["STATE"], known),
        clean_national=keep_known_classes(by_level["NATIONAL"], known),
        redundant=redundant, known=known,
    )


def clean_levels_per_level(core: DataFrame) -> LevelTables:
    """Same tables with one roll-up per level (the reference's three passes);
    kept for the equivalence test and the one-pass comparison in the bench."""
    known_county = drop_redundant_totals(rollup_level(core, "COUNTY"), varied_commodities(core))
    return LevelTables(
        known_county=known_county,
        clean_state=keep_known_classes(rollup_level(core, "STATE"), known_classes(known_county)),
        clean_national=keep_known_classes(rollup_level(core, "NATIONAL"), known_classes(known_county)),
    )
