"""Delimited export (escaped, gzip, header per file) and export checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an exported file: gzip can't be split, so files of one size let a reader share them out.
ROWS_PER_FILE = 1_000_000


def escape(field: Column, sep: str = "\t") -> Column:
    """Backslash-escape a text field so no writer quoting rule can trigger:
    backslash, separator, newline, carriage return, NUL and a leading ``#``."""
    f = F.replace(field, F.lit("\\"), F.lit("\\\\"))
    f = F.replace(f, F.lit("\t"), F.lit("\\t"))
    f = F.replace(f, F.lit("\n"), F.lit("\\n"))
    f = F.replace(f, F.lit("\r"), F.lit("\\r"))
    f = F.replace(f, F.lit("\u0000"), F.lit("\\0"))
    if sep not in ("\t", "\n", "\r"):
        f = F.replace(f, F.lit(sep), F.lit("\\" + sep))
    return F.when(f.startswith("#"), F.concat(F.lit("\\"), f)).otherwise(f)


def escaped_fields(fields: Sequence[Column], sep: str = "\t") -> Column:
    """The escaped fields of a row as an array; NULLs stay.

    Few rows hold anything to escape, so a row is looked through once, and its fields are escaped only if it does.
    (Escapes written out per column compile to one method that is too large for the JIT from some 15 columns on.)
    """
    special = "[\\\\\t\n\r\\x00#" + re.escape(sep) + "]"
    texts = F.array(*fields)
    return F.when(F.array_join(texts, " ").rlike(special), F.transform(texts, lambda f: escape(f, sep))).otherwise(texts)


def export_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True,
                     compression: str = "gzip", single_file: bool = False, null_as: str = "",
                     mode: str = "overwrite") -> None:
    """Write ``df`` as escaped delimited text.

    Sharded by default (one file per task and ``ROWS_PER_FILE`` rows, each with a header line; any
    reader of the folder skips every file's header).  ``single_file`` gives the
    reference's one-file output by shuffling everything into one writer task:
    it serialises the write, so it is an opt-in for small outputs only and no
    registered query uses it.  NULL is written as ``null_as`` (empty by default, the same
    as an empty string; pass ``\\N`` to keep them apart).  Spark's CSV writer
    is used after escaping, with quoting off and trimming off.
    """
    fields = escaped_fields([F.col(f"`{c}`").cast("string") for c in df.columns], sep)
    escaped = df.select(fields.alias("_fields")).select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(df.columns)])
    out = escaped.repartition(1) if single_file else escaped
    (out.write.mode(mode).option("maxRecordsPerFile", 0 if single_file else ROWS_PER_FILE)
     .option("sep", sep).option("header", header).option("quote", "").option("escapeQuotes", False)
     .option("quoteAll", False).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("nullValue", null_as).option("emptyValue", "")
     .option("compression", compression)
     .csv(path))


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Listing of the files under ``path``: path, size, modification time.
    Only metadata is read (the file content column is pruned)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def export_check(exported: DataFrame, table: DataFrame) -> DataFrame:
    """One row: rows read back from an export vs rows of the table."""
    return (exported.agg(F.count(F.lit(1)).alias("exported_rows"))
            .select("exported_rows", table.select(F.count(F.lit(1))).scalar().alias("table_rows"))
            .withColumn("rows_match", F.col("exported_rows") == F.col("table_rows")))
