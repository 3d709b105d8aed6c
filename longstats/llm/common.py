"""Small helpers shared by the operators: table reads, staging, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longstats.session import checkpoint_root, materialize

# fixed values: the white space of the word definition, and its complement
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

__all__ = ["SPACE_CLASS", "WORD", "ascii_lower", "read_table", "stage", "word_count", "doc_crc", "text_chunks"]


#: Rows per Arrow batch: rows here are whole texts, and a task holds a few batches at a time.
ROWS_PER_BATCH = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; also sizes the session's Arrow batches for rows of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back (lineage ends there)."""
    checkpoint_root(df.sparkSession)
    return materialize(df, name)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of ``WORD`` matches; NULL and blank texts count 0.

    One regular-expression pass that turns each word (and the white space
    after it) into one character, so no array of words is built.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACE_CLASS}]+", "")
    return F.length(F.regexp_replace(body, rf"{WORD}[{SPACE_CLASS}]*", "x")).cast("long")


def doc_crc(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the decimal text of the id, modulo ``modulus`` (NULL id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_chunks(column, limit: int = 8 << 20):
    """Row ranges of an Arrow string column whose UTF-8 bytes stay near ``limit`` (one row may exceed it)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
