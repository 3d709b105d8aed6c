"""Numeric expressions: guarded parse of grouped decimal text, safe ratios, year dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number text: optional sign, digits either grouped by commas in
# threes or ungrouped, optional fraction; or a bare fraction such as ``.5``.
# Surrounding whitespace is allowed.  Anything else (``(D)``, ``1e5``, ``NaN``,
# ``12,34``, ``-``) parses to NULL.
NUMBER_TEXT = r"^\s*-?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?\s*$|^\s*-?\.\d+\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_grouped_decimal(c: str | Column, precision: int = 38, scale: int = 3) -> Column:
    """Parse text such as ``433,100`` or ``1,234.5`` to ``decimal(precision, scale)``.

    Mirrors a try-parse with a ``999,999,...999.999`` format: bad text gives NULL,
    never an error.  Extra decimals round half-up; ``scale=0`` rounds each value
    to an integer before any later sum.  The guard regex rejects forms a bare
    cast would accept (exponents, ``NaN``, misplaced separators).
    """
    col = _col(c)
    cleaned = F.replace(col, F.lit(","), F.lit(""))
    return F.when(col.rlike(NUMBER_TEXT), cleaned.try_cast(f"decimal({precision},{scale})"))


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator as double; NULL when the denominator is 0 or NULL.

    Division is done in double: ``decimal(38,3) / decimal(38,3)`` keeps only six
    decimals in Spark.
    """
    den = _col(denominator).cast("double")
    return _col(numerator).cast("double") / F.nullif(den, F.lit(0.0))


def year_date(year: str | Column = "year") -> Column:
    """January 1st of ``year`` as a date."""
    return F.make_date(_col(year), F.lit(1), F.lit(1))
