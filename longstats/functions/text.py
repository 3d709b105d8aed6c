"""Text expressions: title casing, anchored regex predicates, NULL-propagating ids,
multi-token NULL normalisation.  All are native Column expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word delimiters of the reference's INITCAP — whitespace and
#   ! ? @ " ^ # $ & ~ _ , . : ; + - * % / | \ [ ] ( ) { } < >
# written here as the body of a regex character class.
TITLE_DELIMITERS = r"""\s!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""

# Text the reference's loader reads as NULL (empty included).
NULL_TOKENS = ("NULL", "null", "\\N", "")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c: str | Column) -> Column:
    """Upper-case the first letter of each word, lower-case the rest.

    A word starts after whitespace or any punctuation in TITLE_DELIMITERS, so
    ``SPRING, (EXCL DURUM)`` -> ``Spring, (Excl Durum)``, ``MIAMI-DADE`` ->
    ``Miami-Dade``, ``O'BRIEN`` -> ``O'brien``.  Spark's ``initcap`` only splits
    on spaces.  The text is cut before each word start (zero-width split),
    each piece gets its first character upper-cased, and the pieces are joined.
    """
    d = TITLE_DELIMITERS
    pieces = F.split(F.lower(_col(c)), f"(?<=[{d}])(?=[^{d}])")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        "",
    )


def full_match(c: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whole-value regex match (the reference's implicitly anchored REGEXP_LIKE).

    ``rlike`` finds a match anywhere, so the pattern is anchored with ``\\A`` /
    ``\\z``.  ``(?d)`` makes ``\\n`` the only line terminator, so ``.`` stops at
    a newline exactly as in the reference's POSIX dialect.
    """
    flags = "(?id)" if ignore_case else "(?d)"
    return _col(c).rlike(rf"{flags}\A(?:{pattern})\z")


def county_id(state_code: str | Column = "state_fips_code",
              county_code: str | Column = "county_code") -> Column:
    """State code || county code; NULL when either part is NULL (``||`` semantics)."""
    return F.concat(_col(state_code), _col(county_code))


def null_if_token(c: str | Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """NULL when the trimmed value is one of ``tokens`` (Spark's reader takes one token)."""
    col = _col(c)
    return F.when(F.trim(col).isin(list(tokens)), F.lit(None).cast(StringType())).otherwise(col)


def normalise_nulls(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS,
                    columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NULL tokens in every string column (or ``columns``) in one projection."""
    tokens = list(tokens)
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*[
        null_if_token(f.name, tokens).alias(f.name) if f.name in targets else F.col(f.name)
        for f in df.schema.fields
    ])
