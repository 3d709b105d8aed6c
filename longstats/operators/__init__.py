"""DataFrame -> DataFrame operators of the cleaning job and its profiles."""

from longstats.operators.asof import asof_join
from longstats.operators.bands import band_join
from longstats.operators.dimension import (
    dimension_versions,
    duplicate_keys,
    edition_stems,
    fips_text,
    join_dimension,
    match_summary,
)
from longstats.operators.levels import (
    LevelTables,
    clean_levels,
    clean_levels_per_level,
    drop_redundant_totals,
    keep_known_classes,
    known_classes,
    rollup,
    rollup_level,
    varied_commodities,
)
from longstats.operators.pivot import conditional_pivot, source_stat_measures
from longstats.operators.profile import (
    check_load,
    coverage_profile,
    distinct_combos,
    distinct_nondefault,
    label_breakdown,
    names_shared,
    null_key_levels,
    numeric_format_profile,
    period_profile,
    row_count,
    source_stat_pivot,
    unit_inventory,
    varied_classes,
    variety_from_label,
)
from longstats.operators.residual import (
    duplicate_parents,
    reconcile_gate,
    reconcile_levels,
    residual_backfill,
    rollup_measures,
    tidy_table,
    union_aligned,
)
from longstats.operators.scope import any_present, core_scope, crop_filter, effective_class, level_scope
from longstats.operators.series import (
    change_on_previous,
    moving_ratio,
    moving_sums,
    ranked,
    running_total,
    top_per_group,
)
from longstats.operators.sketches import column_sketches, merge_sketches, sketch_report
from longstats.operators.snapshot import (
    changed_groups,
    except_all,
    expand,
    intersect_all,
    snapshot_diff,
    snapshot_summary,
)
from longstats.operators.totals import at_level, cube_sets, level_totals, rollup_sets
from longstats.operators.trends import unit_yield_trend, yield_trend
from longstats.operators.units import classify_units, unit_columns
from longstats.operators.windows import with_grand_total, with_partition_total

__all__ = [name for name in dir() if not name.startswith("_")]
