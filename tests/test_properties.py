"""Property tests: Spark expressions against small pure-Python references on
generated inputs (one Spark job per generated batch)."""

import re
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from longstats.functions import NUMBER_TEXT, parse_grouped_decimal, title_case
from longstats.session import scratch_path
from longstats.sources import export_delimited, read_escaped

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

# Python model of the title-case rule: a character is upper-cased when it is
# first or follows a delimiter; everything else is lower-cased.
DELIMS = set(" \t\n\x0b\x0c\r") | set("!?@\"^#$&~_,.:;+-*%/|\\[](){}<>")


def py_title(s):
    if s is None:
        return None
    low = s.lower()
    return "".join(c.upper() if i == 0 or low[i - 1] in DELIMS else c for i, c in enumerate(low))


GUARD = re.compile(NUMBER_TEXT)


def py_parse(v, scale=3):
    if v is None or not GUARD.search(v):
        return None
    d = Decimal(v.replace(",", "").strip())
    return d.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)


TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ éñÑ'0123") + sorted(DELIMS)), max_size=24)


@SETTINGS
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=150))
def test_title_case_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == [py_title(v) for v in values]


def _grouped(n):
    s = str(n)
    return f"{n:,}" if n >= 1000 else s


NUMBERS = st.builds(
    lambda sign, n, grouped, frac, pad: (" " * pad) + sign + (_grouped(n) if grouped else str(n)) + frac + (" " * pad),
    st.sampled_from(["", "-"]), st.integers(0, 10**12), st.booleans(),
    st.one_of(st.just(""), st.just("."), st.from_regex(r"\.[0-9]{1,6}", fullmatch=True)),
    st.integers(0, 2))
JUNK = st.text(alphabet=st.sampled_from(list("0123456789,.-eE( )DNa")), max_size=12)


@SETTINGS
@given(st.lists(st.one_of(NUMBERS, JUNK, st.none()), min_size=1, max_size=200), st.sampled_from([0, 3]))
def test_parse_matches_model(spark, values, scale):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(parse_grouped_decimal("v", 38, scale)).collect()]
    assert got == [py_parse(v, scale) for v in values]


SCHEMA = StructType([StructField("name", StringType()), StructField("year", IntegerType(), False),
                     StructField("value", StringType())])
# letters of the escape sequences included, so text such as backslash + "t" is generated
RAW = st.text(alphabet=st.sampled_from(list("ab #\\\"'\t\n\r\x00N,|tnr0")), max_size=12)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), RAW), st.one_of(st.none(), RAW)), min_size=1, max_size=60))
def test_export_then_escaped_read_is_identity(spark, pairs):
    rows = [(a, i, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "prop-export")
    export_delimited(df, path, null_as="\\N")
    back = read_escaped(spark, path, SCHEMA, trim=False, null_tokens=("\\N",))
    assert sorted(back.collect(), key=lambda r: r.year) == sorted(df.collect(), key=lambda r: r.year)
