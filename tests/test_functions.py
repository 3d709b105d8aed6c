"""Column expressions: traps T1-T4, T7, T8 on literal rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from longstats.functions import (
    asc_ref,
    county_id,
    desc_ref,
    full_match,
    normalise_nulls,
    ordered_list,
    parse_grouped_decimal,
    safe_ratio,
    sorted_set,
    title_case,
    year_date,
)

TITLE_CASES = [
    ("SPRING, (EXCL DURUM)", "Spring, (Excl Durum)"),
    ("OTHER (COMBINED) COUNTIES", "Other (Combined) Counties"),
    ("MIAMI-DADE", "Miami-Dade"),
    ("O'BRIEN", "O'brien"),
    ("DOÑA ANA", "Doña Ana"),
    (" LEAD", " Lead"),
    ("AREA PLANTED (ONLY)", "Area Planted (Only)"),
    ("480 LB BALES", "480 Lb Bales"),
    ("corn/soy|wheat", "Corn/Soy|Wheat"),
    ("a.b_c#d", "A.B_C#D"),
    ("", ""),
    (None, None),
]

def test_title_case_t1(spark):
    df = spark.createDataFrame([(a,) for a, _ in TITLE_CASES], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == [b for _, b in TITLE_CASES]

def test_title_case_idempotent(spark):
    df = spark.createDataFrame([(a,) for a, _ in TITLE_CASES], "s string")
    once = df.select(title_case("s").alias("s"))
    twice = once.select(title_case("s").alias("s"))
    assert once.collect() == twice.collect()

def test_county_id_propagates_null_t2(spark):
    df = spark.createDataFrame([("38", "998"), ("38", None), (None, "998")], "a string, b string")
    assert [r[0] for r in df.select(county_id("a", "b")).collect()] == ["38998", None, None]

PARSE_CASES = [
    ("433,100", Decimal("433100.000")), ("820", Decimal("820.000")), (".5", Decimal("0.500")),
    ("0.5", Decimal("0.500")), ("12.", Decimal("12.000")), ("1234", Decimal("1234.000")),
    ("1,234.567", Decimal("1234.567")), ("1,234.5678", Decimal("1234.568")), ("-5", Decimal("-5.000")),
    (" 433,100 ", Decimal("433100.000")), ("(D)", None), ("12,34", None), ("1e5", None), ("NaN", None),
    ("-", None), (".", None), ("", None), (None, None), ("1,000,000,000.999", Decimal("1000000000.999")),
]

def test_parse_grouped_decimal_t3(spark):
    df = spark.createDataFrame([(a,) for a, _ in PARSE_CASES], "v string")
    out = df.select(parse_grouped_decimal("v").alias("n"))
    assert out.schema["n"].dataType.simpleString() == "decimal(38,3)"
    assert [r[0] for r in out.collect()] == [b for _, b in PARSE_CASES]

def test_parse_scale_zero_rounds_each_value_t4(spark):
    df = spark.createDataFrame([("2.5",), ("-2.5",)], "v string")
    assert [r[0] for r in df.select(parse_grouped_decimal("v", 38, 0)).collect()] == [3, -3]
    three = spark.createDataFrame([("0.4",)] * 3, "v string")
    assert three.select(F.sum(parse_grouped_decimal("v", 38, 0))).first()[0] == 0
    assert three.select(F.sum(parse_grouped_decimal("v", 38, 3))).first()[0] == Decimal("1.200")

def test_full_match_is_anchored_t8(spark):
    df = spark.createDataFrame([("CORN",), ("SWEET CORN",), ("popcorn",), ("X\nCORN",), ("BARLEY",), (None,)],
                               "c string")
    got = [r[0] for r in df.select(full_match("c", ".*(corn|rice).*", ignore_case=True)).collect()]
    assert got == [True, True, True, False, False, None]
    cs = [r[0] for r in df.select(full_match("c", ".*(CORN).*")).collect()]
    assert cs == [True, True, False, False, False, None]

def test_reference_null_ordering_t7(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r[0] for r in df.orderBy(asc_ref("x")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(desc_ref("x")).collect()] == [None, 2, 1]

def test_normalise_nulls_tokens(spark):
    df = spark.createDataFrame([("NULL", "a"), ("null", " \\N "), ("", "x"), ("NUL", None)], "a string, b string")
    got = [tuple(r) for r in normalise_nulls(df).collect()]
    assert got == [(None, "a"), (None, None), (None, "x"), ("NUL", None)]

def test_safe_ratio_and_year_date(spark):
    df = spark.createDataFrame([(10.0, 4.0, 1999), (1.0, 0.0, 2000), (1.0, None, 2001)], "a double, b double, y int")
    got = df.select(safe_ratio("a", "b").alias("r"), year_date("y").cast("string").alias("d")).collect()
    assert [r.r for r in got] == [2.5, None, None]
    assert [r.d for r in got] == ["1999-01-01", "2000-01-01", "2001-01-01"]

def test_sorted_set_and_ordered_list(spark):
    df = spark.createDataFrame([("s", 2001, "b"), ("s", 1999, "a"), ("s", 2001, "a"), ("s", None, None),
                                ("s", 1999, "a")], "k string, y int, v string")
    row = df.groupBy("k").agg(sorted_set("y").alias("ys"), ordered_list("v", "y").alias("vs")).first()
    assert row.ys == [1999, 2001]
    assert row.vs == ["a", "a", "a", "b"]
