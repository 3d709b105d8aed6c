"""Delimited text readers under a declared schema.

Two paths:

* ``read_delimited``: Spark's CSV reader with quoting off.  Fast and
  splittable, for files without backslash escapes.
* ``read_escaped`` / ``read_with_quarantine``: the text source plus native
  field splitting, for files that use backslash escapes, need UTF-8
  validation, or where bad records must be kept aside instead of failing the
  load.

Escape convention (shared with ``export_delimited``): ``\\\\`` is a backslash,
``\\t`` ``\\n`` ``\\r`` ``\\0`` are tab, newline, carriage return and NUL, and a
backslash before any other character (the separator, ``#``) stands for that
character.

The header is skipped by position, as the first line of every file, whatever
it says; a later line that equals it is data.  Lines of white space only hold no
value and are skipped by both paths.

gzip input is not splittable (one task per file), so the lines of gz files, given
by name or found in a folder, are spread over the cluster before they are parsed
(``read_escaped``) or right after the scan that parses them (``read_delimited``),
unless the files are as many as the cores and none is large.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from longstats.functions.text import NULL_TOKENS, normalise_nulls

MODES = ("FAILFAST", "DROPMALFORMED")


#: Bytes of the largest gz file that one task may take in whole (Spark's default for a task's share of files).
WHOLE_FILE = 128 * 2 ** 20

# A byte that no UTF-8 text holds, as the separator of a reader that must not split lines.
_NO_SPLIT = "\u00ff"


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _spread_gzip(df: DataFrame, paths: Sequence[str], partitions: int | None) -> DataFrame:
    """Spread rows that come out of gz files (one task per file): to ``partitions`` tasks, or else
    to as many as their size asks for.  Files that are as many as the cluster's cores, none larger
    than a task's share of a splittable file, are shared out already and aren't shuffled."""
    if partitions is not None:
        return df.repartition(partitions)
    if not any(f.endswith(".gz") for f in df.inputFiles()):
        return df
    spark = df.sparkSession
    files = spark.read.format("binaryFile").load(list(paths))
    n, largest = files.agg(F.count(F.lit(1)), F.max("length")).first()
    whole = largest is not None and largest <= WHOLE_FILE and n >= spark.sparkContext.defaultParallelism
    return df if whole else df.hint("rebalance")


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: StructType, sep: str = "\t",
                   header: bool = True, trim: bool = True, null_tokens: Iterable[str] = NULL_TOKENS,
                   mode: str = "FAILFAST", partitions: int | None = None) -> DataFrame:
    """Read delimited text with quoting off (a lone ``"`` stays data).

    Empty fields and every trimmed value in ``null_tokens`` become NULL (Spark's
    own ``nullValue`` takes one token, so the rest are mapped in one projection).
    ``mode`` is FAILFAST (a record with the wrong field count or a bad number
    fails the load) or DROPMALFORMED.

    Every record is checked whole, whichever columns a consumer asks for: the
    reader keeps the text of a malformed record in one more column, and the rows
    are checked against it before any projection.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    paths = _paths(path)
    corrupt = "_malformed"
    # all fields are asked for, so that none is left unparsed
    asked = StructType([*schema.fields, StructField(corrupt, StringType())])
    df = (spark.read.schema(asked)
          .option("sep", sep).option("header", header).option("quote", "")
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("nullValue", "")
          .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
          .csv(paths))
    names = [f.name for f in schema.fields]
    return normalise_nulls(_checked(_spread_gzip(df, paths, partitions), corrupt, names, mode).select(*names), null_tokens)


def _checked(df: DataFrame, reason: str, others: Sequence[str], mode: str) -> DataFrame:
    """Drop the rows that have a ``reason``, or fail on the first of them.

    ``others`` are columns of the record for the message.  Both branches read them, so that the
    reader converts (and judges) these columns even if nobody else asks for them.
    """
    bad, text = F.col(reason).isNotNull(), F.concat_ws(" ", *[F.col(c).cast("string") for c in others])
    if mode == "FAILFAST":
        gone = F.raise_error(F.concat(F.lit("malformed record ("), F.col(reason), F.lit("): "), text)).cast("boolean")
    else:
        gone = F.length(text) < 0
    return df.filter(F.when(bad, gone).otherwise(F.lit(True)))


def split_escaped(line: Column, sep: str = "\t") -> Column:
    """Split a line on separators not escaped by a backslash; fields keep their escapes."""
    s = re.escape(sep)
    # unrolled loop with possessive quantifiers: linear, no per-character
    # backtracking or recursion, so long fields cannot overflow the stack
    field = rf"[^{s}\\]*+(?:\\[\s\S][^{s}\\]*+)*+"
    return F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf"{s}({field})"), 1)


def unescape(field: Column) -> Column:
    """Undo the backslash escapes of one field (see the module docstring).

    Pieces between escaped backslashes are unescaped separately and joined
    with a single backslash.  (An equivalent chain of lookbehind
    ``regexp_replace``s compiles to one generated method too large for the JIT
    over 19 fields and ran 2.5x slower at sf0.1.)
    """
    def piece(p: Column) -> Column:
        p = F.regexp_replace(p, r"\\t", "\t")
        p = F.regexp_replace(p, r"\\n", "\n")
        p = F.regexp_replace(p, r"\\r", "\r")
        p = F.regexp_replace(p, r"\\0", "\u0000")
        return F.regexp_replace(p, r"\\([\s\S])", "$1")
    return F.array_join(F.transform(F.split(field, r"\\\\"), piece), "\\")


def _parse(lines: DataFrame, schema: StructType, sep: str, trim: bool, null_tokens: Iterable[str],
           validate_utf8: bool) -> DataFrame:
    """Raw lines -> fields + typed columns + ``_reason`` (NULL when the line is good)."""
    tokens = list(null_tokens)
    names = [f.name for f in schema.fields]
    lines = lines.select(F.col("value").alias("_line"), F.col("valid").alias("_valid"))
    line = F.col("_line")
    fields = F.col("_fields")
    # The split goes through a one-element generator: filters cannot be pushed
    # below a Generate, so the split regex runs once per line instead of being
    # inlined into the row checks once per field.
    body = F.when(line.endswith("\r"), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    # a line without a backslash is cut at every separator, for which no regular expression is needed
    plain = F.split(body, re.escape(sep), -1)
    split = F.struct(F.when(line.contains("\\"), split_escaped(body, sep)).otherwise(plain).alias("_fields"))
    parsed = lines.select(line, "_valid", F.inline(F.array(split)))
    cols, bad_type = [], F.lit(False)
    for i, f in enumerate(schema.fields):
        raw = F.get(fields, i)
        raw = F.trim(raw) if trim else raw
        text = (F.when(raw.isin(tokens), F.lit(None).cast(StringType()))
                 .when(raw.contains("\\"), unescape(raw)).otherwise(raw))
        if isinstance(f.dataType, StringType):
            typed = text
        else:
            typed = text.try_cast(f.dataType)
            bad_type = bad_type | (text.isNotNull() & typed.isNull())
        if not f.nullable:
            bad_type = bad_type | typed.isNull()
        cols.append(typed.alias(f.name))
    reason = F.when(F.size(fields) != len(names), F.lit("field_count")).when(bad_type, F.lit("bad_value"))
    if validate_utf8:
        reason = F.when(~F.col("_valid"), F.lit("invalid_utf8")).otherwise(reason)
    return parsed.select(line, *cols, reason.alias("_reason"))


def read_lines(spark: SparkSession, path: str | Sequence[str], header: bool = False,
               partitions: int | None = None) -> DataFrame:
    """Lines of text files: ``value`` and ``valid`` (whether its bytes are UTF-8; if not, bad bytes are replaced).

    With ``header`` the first line of every file is skipped, by position.  The
    bytes are read one to one (as ISO-8859-1) and judged as they are in the file.
    """
    raw = (spark.read.schema("line string, rest string")
           .option("header", header).option("sep", _NO_SPLIT).option("quote", "").option("escape", "")
           .option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").option("maxCharsPerColumn", -1)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("enforceSchema", True).csv(_paths(path)))
    raw = _spread_gzip(raw, _paths(path), partitions)
    # a line with that byte comes in two pieces; it is not UTF-8
    data = F.encode(F.concat_ws(_NO_SPLIT, "line", "rest"), "ISO-8859-1").cast("string")
    return raw.select(F.make_valid_utf8(data).alias("value"), F.is_valid_utf8(data).alias("valid"))


def read_escaped(spark: SparkSession, path: str | Sequence[str], schema: StructType, sep: str = "\t",
                 header: bool = True, trim: bool = True, null_tokens: Iterable[str] = NULL_TOKENS,
                 validate_utf8: bool = True, mode: str = "FAILFAST",
                 partitions: int | None = None) -> DataFrame:
    """Read backslash-escaped delimited text under ``schema``.

    FAILFAST aborts the job on the first bad record (wrong field count, a value
    that does not fit its type, a NULL in a required column, invalid UTF-8);
    DROPMALFORMED drops such records.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parsed = _parse(read_lines(spark, path, header, partitions), schema, sep, trim, null_tokens, validate_utf8)
    return _checked(parsed, "_reason", ["_line"], mode).select(*[f.name for f in schema.fields])


def read_with_quarantine(spark: SparkSession, path: str | Sequence[str], schema: StructType,
                         sep: str = "\t", header: bool = True, trim: bool = True,
                         null_tokens: Iterable[str] = NULL_TOKENS, validate_utf8: bool = True,
                         materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows under ``schema``, rejected lines with ``line`` and ``reason``).

    Both sides are filters of one parse.  With ``materialize`` the parsed rows
    are written once to the shared checkpoint folder, so consuming both sides
    scans and parses the input once.
    """
    parsed = _parse(read_lines(spark, path, header), schema, sep, trim, null_tokens, validate_utf8)
    if materialize:
        from longstats.session import materialize as write_back
        parsed = write_back(parsed, "quarantine-parse")
    good = parsed.filter(F.col("_reason").isNull()).select(*[f.name for f in schema.fields])
    bad = parsed.filter(F.col("_reason").isNotNull()).select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return good, bad


def read_dimension(spark: SparkSession, path: str | Sequence[str], sep: str = "\t", header: bool = True,
                   escaped: bool = True, **options) -> DataFrame:
    """Load the 45-column county classification dimension (text keys + doubles)."""
    from longstats.schemas import DIMENSION_SCHEMA
    reader = read_escaped if escaped else read_delimited
    return reader(spark, path, DIMENSION_SCHEMA, sep=sep, header=header, **options)
