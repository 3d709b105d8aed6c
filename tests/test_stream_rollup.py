"""The streamed roll-up equals the batch roll-up of the distinct rows; replays change nothing and late rows are counted."""

import pytest
from pyspark.sql import functions as F

from longstats.functions.numbers import parse_grouped_decimal
from longstats.session import scratch_path
from longstats.streaming import merge_groups, rollup_stream
from pyspark.sql.types import IntegerType, StringType, StructType

SCHEMA = StructType().add("state", StringType()).add("crop", StringType()).add("year", IntegerType()).add("value", StringType())
KEYS = ["year", "state", "crop"]


def _totals():
    return {"row_count": F.count(F.lit(1)), "total": F.sum(parse_grouped_decimal("value"))}


def _time():
    return F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def _drop(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA)
    (df.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).option("quote", "")
     .option("emptyValue", "").csv(path))


def _run(spark, source, base):
    return rollup_stream(spark, source, SCHEMA, f"{base}/table", f"{base}/checkpoint", KEYS, _totals(), _time(), "1000 days")


def _table(spark, base):
    return sorted(map(str, spark.read.parquet(f"{base}/table").select(*KEYS, *_totals()).collect()))


def _batch(spark, rows):
    return sorted(map(str, spark.createDataFrame(rows, SCHEMA).distinct().groupBy(*KEYS).agg(*[c.alias(n) for n, c in _totals().items()])
                      .select(*KEYS, *_totals()).collect()))


def test_replays_change_nothing_and_late_rows_are_counted(spark):
    source, base = scratch_path(spark, "drops"), scratch_path(spark, "rollup")
    first = [(s, c, y, str(10 * y + i)) for i, s in enumerate(("A", "B", None)) for c in ("CORN", "RICE") for y in (2000, 2001, 2002)] + [("A", "CORN", 2002, "(D)")]
    _drop(spark, first, source)
    report = _run(spark, source, base)
    assert (report.input_rows, report.late_rows, report.repeated_rows) == (len(first), 0, 0)
    assert _table(spark, base) == _batch(spark, first)

    # the same drop again: 2002 is within the watermark and told as repeated, older years are late
    _drop(spark, first, source)
    report = _run(spark, source, base)
    old = sum(r[2] == 2000 for r in first)
    assert report.input_rows == len(first) and report.late_rows + report.repeated_rows == len(first) and report.repeated_rows > 0
    assert report.late_rows in (0, old, sum(r[2] <= 2001 for r in first))
    assert _table(spark, base) == _batch(spark, first)

    # new rows join groups that stand already; what comes too late is counted and left out
    more = [("A", "CORN", 2002, "5"), ("C", "OATS", 2005, "1"), (None, "RICE", 2002, "7")]
    _drop(spark, more, source)
    report = _run(spark, source, base)
    assert (report.late_rows, report.repeated_rows) == (0, 0)
    assert _table(spark, base) == _batch(spark, first + more)
    _drop(spark, [("A", "CORN", 1990, "1"), ("C", "OATS", 2005, "2")], source)
    report = _run(spark, source, base)
    assert (report.input_rows, report.late_rows) == (2, 1)
    assert _table(spark, base) == _batch(spark, first + more + [("C", "OATS", 2005, "2")])
    # nothing new: nothing happens
    assert _run(spark, source, base).input_rows == 0


def test_a_merge_run_twice_leaves_the_same_table(spark):
    target = scratch_path(spark, "merged")
    schema = "year int, state string, n long"
    first = spark.createDataFrame([(2000, "A", 1), (2000, None, 2), (2001, "A", 3)], schema)
    later = spark.createDataFrame([(2000, None, 5), (2002, "B", 1)], schema)
    merge_groups(first, target, ["year", "state"], "year")
    for _ in range(2):
        merge_groups(later, target, ["year", "state"], "year")
        got = sorted(map(str, (tuple(r) for r in spark.read.parquet(target).select("year", "state", "n").collect())))
        assert got == sorted(map(str, [(2000, "A", 1), (2000, None, 5), (2001, "A", 3), (2002, "B", 1)]))
    merge_groups(later.limit(0), target, ["year", "state"], "year")
    assert spark.read.parquet(target).count() == 4


def test_period_must_be_a_key(spark):
    with pytest.raises(ValueError, match="year"):
        rollup_stream(spark, "x", SCHEMA, "y", "z", ["state"], _totals(), _time(), "1 day")


def test_the_state_keeps_hashes_of_rows_and_lies_in_rocksdb(spark):
    """Before: whole rows, on the heap."""
    import json
    source, base = scratch_path(spark, "drops"), scratch_path(spark, "rollup")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    _drop(spark, [("A", "CORN", 2000, "1"), ("A", None, 2000, "1"), ("A", "CORN", 2000, "1"), (None, "A", 2000, "1")], source)
    assert _run(spark, source, base).repeated_rows == 1
    assert spark.conf.get(name) == before
    metadata = json.loads(spark.read.text(f"{base}/checkpoint/offsets/0").collect()[1][0])
    assert metadata["conf"][name].endswith("RocksDBStateStoreProvider")
    assert spark.read.format("statestore").option("operatorId", 1).load(f"{base}/checkpoint").selectExpr("key.*").columns == ["_h1", "_h2"] \
        or spark.read.format("statestore").option("operatorId", 0).load(f"{base}/checkpoint").selectExpr("key.*").columns == ["_h1", "_h2"]
