"""Residual backfill (parent minus known children as an UNSPECIFIED member), the tidy
output table, aligned unions and cross-level reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longstats.functions.numbers import year_date
from longstats.functions.text import title_case
from longstats.operators.scope import any_present
from longstats.schemas import TIDY_COLUMNS

UNSPECIFIED = "UNSPECIFIED"
RESIDUAL_KEYS = ["year", "commodity_desc", "commodity_class_desc", "state_name"]
RESIDUAL_MEASURES = ["area_planted", "area_harvested", "crop_production"]
UNIT_COLUMNS = ["production_unit", "production_unit_conversion", "production_unit_multiplier",
                "yield_unit", "production_to_yield_multiplier"]


def rollup_measures(df: DataFrame, keys: Sequence[str],
                    measures: Sequence[str] = ("area_planted", "area_harvested", "crop_production",
                                               "crop_yield")) -> DataFrame:
    """Re-aggregate already aggregated rows to coarser keys (plain SUMs)."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def residual_backfill(parent: DataFrame, children: DataFrame, how: str = "left",
                      keys: Sequence[str] = RESIDUAL_KEYS,
                      measures: Sequence[str] = RESIDUAL_MEASURES) -> DataFrame:
    """parent measure - sum of child measures (missing child sum = 0), as an
    ``UNSPECIFIED`` county; a zero difference becomes NULL.  Negative residuals
    are kept.

    ``how="full"`` reproduces the reference's intermediate table, which also
    has child-only rows (all NULL apart from ``county_state_name``).  Those rows
    never survive the tidy table's any-measure filter, so ``how="left"`` gives
    the same final product with a join Catalyst may broadcast.  The join keys
    use plain equality: a NULL state never matches.  A parent with two rows for
    one key (two raw classes with the same effective class) subtracts the
    child sum from each, as the reference does.
    """
    k = rollup_measures(children, keys, measures).alias("k")
    p = parent.alias("p")
    cond = [F.col(f"p.{c}") == F.col(f"k.{c}") for c in keys]
    joined = p.join(k, cond, how)
    residuals = [F.nullif(F.col(f"p.{m}") - F.coalesce(F.col(f"k.{m}"), F.lit(0)), F.lit(0)).alias(m)
                 for m in measures]
    return joined.select(
        F.col("p.year").alias("year"), F.col("p.commodity_desc").alias("commodity_desc"),
        F.col("p.commodity_class_desc").alias("commodity_class_desc"),
        F.col("p.state_alpha").alias("state_alpha"), F.col("p.state_name").alias("state_name"),
        F.lit(UNSPECIFIED).alias("county_name"), F.col("k.state_name").alias("county_state_name"),
        *[F.col(f"p.{c}").alias(c) for c in UNIT_COLUMNS], *residuals)


def duplicate_parents(parent: DataFrame, keys: Sequence[str] = RESIDUAL_KEYS) -> DataFrame:
    """Keys that several parent rows share, with their number.

    ``residual_backfill`` subtracts the children's sum from each such row, so their residuals overlap; this
    reports them.
    """
    return (parent.groupBy(*keys).agg(F.count(F.lit(1)).alias("parent_rows"))
            .filter(F.col("parent_rows") > 1))


def union_aligned(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column missing from a frame is a typed NULL."""
    names: list[str] = []
    types: dict[str, object] = {}
    for f in frames:
        for field in f.schema.fields:
            if field.name not in types:
                names.append(field.name)
                types[field.name] = field.dataType
    aligned = [f.select(*[F.col(n) if n in f.columns else F.lit(None).cast(types[n]).alias(n)
                          for n in names]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), aligned)


def tidy_table(known_county: DataFrame, unspecified: DataFrame) -> DataFrame:
    """Known counties plus UNSPECIFIED residual counties with at least one
    measure, display-cased names, 17 columns."""
    known = known_county.select(
        "year", "calendar_date", "fips_county_code", "state_alpha",
        title_case("state_name").alias("state_name"), title_case("county_name").alias("county_name"),
        "commodity_name", "commodity_class_variety", *UNIT_COLUMNS,
        "area_planted", "area_harvested", "crop_production", "crop_yield")
    residual = unspecified.filter(any_present(*RESIDUAL_MEASURES)).select(
        "year", year_date("year").alias("calendar_date"),
        F.lit(None).cast("string").alias("fips_county_code"), "state_alpha",
        title_case("state_name").alias("state_name"), title_case("county_name").alias("county_name"),
        title_case("commodity_desc").alias("commodity_name"),
        title_case("commodity_class_desc").alias("commodity_class_variety"), *UNIT_COLUMNS,
        "area_planted", "area_harvested", "crop_production",
        F.lit(None).cast("decimal(38,3)").alias("crop_yield"))
    return known.unionByName(residual).select(*TIDY_COLUMNS)


def reconcile_levels(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str],
                     names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Sum ``measures`` per ``keys`` on both sides and report both totals and their
    difference.  A report, not an assertion.  Keys match NULL-safely, so NULL
    groups are compared too; a group present on one side only shows NULLs on
    the other."""
    left = rollup_measures(a, keys, measures).alias("l")
    right = rollup_measures(b, keys, measures).alias("r")
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    joined = left.join(right, cond, "full")
    la, rb = names
    out = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in keys]
    for m in measures:
        out += [F.col(f"l.{m}").alias(f"{m}_{la}"), F.col(f"r.{m}").alias(f"{m}_{rb}"),
                (F.col(f"l.{m}") - F.col(f"r.{m}")).alias(f"{m}_diff")]
    return joined.select(*out)


def reconcile_gate(report: DataFrame, keys: Sequence[str], measures: Sequence[str], names: tuple[str, str] = ("a", "b"),
                   tolerance: float = 0.0) -> DataFrame:
    """The failing figures of a ``reconcile_levels`` report, one row each: keys, ``measure``, both totals, ``diff``, ``reason``.

    A figure fails if one side lacks it (``missing_a`` or ``missing_b``, by the sides' names), or if the sides differ by
    more than ``tolerance`` times the second side (``over`` or ``under`` it).  A figure that both sides lack is none.
    """
    la, rb = names
    figures = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_{la}").cast("decimal(38,3)").alias(la),
                                          F.col(f"{m}_{rb}").cast("decimal(38,3)").alias(rb)) for m in measures]))
    a, b = F.col(la), F.col(rb)
    allowed = F.abs(b).cast("double") * F.lit(float(tolerance))
    reason = (F.when(a.isNull() & b.isNotNull(), f"missing_{la}").when(a.isNotNull() & b.isNull(), f"missing_{rb}")
              .when((a - b).cast("double") > allowed, "over").when((b - a).cast("double") > allowed, "under"))
    return (report.select(*keys, figures).withColumns({"diff": a - b, "reason": reason})
            .filter(F.col("reason").isNotNull()))
