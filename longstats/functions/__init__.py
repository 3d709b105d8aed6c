"""Column-level expressions (all native Spark, no Python UDF)."""

from longstats.functions.collections import asc_ref, desc_ref, ordered_list, sorted_set
from longstats.functions.numbers import NUMBER_TEXT, parse_grouped_decimal, safe_ratio, year_date
from longstats.functions.text import (
    NULL_TOKENS,
    TITLE_DELIMITERS,
    county_id,
    full_match,
    normalise_nulls,
    null_if_token,
    title_case,
)

__all__ = [
    "NULL_TOKENS", "NUMBER_TEXT", "TITLE_DELIMITERS", "asc_ref", "county_id", "desc_ref",
    "full_match", "normalise_nulls", "null_if_token", "ordered_list", "parse_grouped_decimal",
    "safe_ratio", "sorted_set", "title_case", "year_date",
]
