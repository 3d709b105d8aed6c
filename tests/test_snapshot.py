"""Differences of two loads against multisets in Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from longstats.operators.snapshot import changed_groups, except_all, expand, intersect_all, snapshot_diff, snapshot_summary

SCHEMA = "k int, a string, b string, x double"


def _loads(seed=1, n=400):
    rng = random.Random(seed)
    def row():
        return (rng.choice((None, 1, 2, 3, 4)), rng.choice((None, "", "a", "b", "ab")), rng.choice((None, "", "a", "b")), rng.choice((None, 0.5, 2.0)))
    old = [row() for _ in range(n)]
    new = old[n // 10:] + [row() for _ in range(n // 8)] + [old[-1]] * 7
    return old, new


def _frames(spark, *loads):
    return [spark.createDataFrame(rows, SCHEMA).repartition(4) for rows in loads]


def _counted(df):
    out = Counter()
    for r in df.collect():
        out[tuple(r[c] for c in ("k", "a", "b", "x"))] += r["copies"]
    return out


def test_except_and_intersect_all(spark):
    old, new = _loads()
    o, n = _frames(spark, old, new)
    assert _counted(except_all(n, o)) == Counter(new) - Counter(old)
    assert _counted(except_all(o, n)) == Counter(old) - Counter(new)
    assert _counted(intersect_all(o, n)) == Counter(old) & Counter(new)
    assert sorted(map(str, expand(except_all(n, o)).collect())) == sorted(map(str, n.exceptAll(o).collect()))
    assert except_all(o, o).count() == 0


def test_nulls_are_told_from_values_and_from_each_other(spark):
    o, n = _frames(spark, [(1, None, "a", None)], [(1, "a", None, None)])
    assert _counted(except_all(n, o)) == {(1, "a", None, None): 1}
    o, n = _frames(spark, [(1, "ab", "", 0.5)], [(1, "a", "b", 0.5)])
    assert except_all(n, o).count() == 1
    o, n = _frames(spark, [(None, None, None, None)] * 3, [(None, None, None, None)])
    assert _counted(except_all(o, n)) == {(None, None, None, None): 2}


def test_added_removed_and_changed(spark):
    old, new = _loads(2)
    o, n = _frames(spark, old, new)
    got = {c: Counter() for c in ("added", "removed", "before", "after")}
    for r in snapshot_diff(o, n, keys=["k", "a"]).collect():
        got[r["change"]][(r["k"], r["a"], r["b"], r["x"])] += r["copies"]
    more, less = Counter(new) - Counter(old), Counter(old) - Counter(new)
    both = {r[:2] for r in more} & {r[:2] for r in less}
    assert got["after"] == Counter({r: c for r, c in more.items() if r[:2] in both})
    assert got["added"] == Counter({r: c for r, c in more.items() if r[:2] not in both})
    assert got["before"] == Counter({r: c for r, c in less.items() if r[:2] in both})
    assert got["removed"] == Counter({r: c for r, c in less.items() if r[:2] not in both})
    assert {r["change"] for r in snapshot_diff(o, n).select("change").distinct().collect()} == {"added", "removed"}


def test_some_columns_only(spark):
    o, n = _frames(spark, [(1, "a", "b", 0.5), (2, "a", "b", 0.5)], [(1, "a", "c", 2.0), (3, "a", "c", 0.5)])
    got = snapshot_diff(o, n, columns=["k", "a"])
    assert got.columns == ["change", "copies", "k", "a"]
    assert sorted(map(tuple, got.collect())) == [("added", 1, 3, "a"), ("removed", 1, 2, "a")]


def test_summary_and_changed_groups(spark):
    old, new = _loads(3)
    o, n = _frames(spark, old, new)
    got = {r["k"]: tuple(r)[1:] for r in snapshot_summary(o, n, ["k"]).collect()}
    for k in {r[0] for r in old + new}:
        a, b = (Counter(r for r in rows if r[0] == k) for rows in (old, new))
        kept = sum((a & b).values())
        assert got[k] == (sum(a.values()), sum(b.values()), kept, sum((b - a).values()), sum((a - b).values()))
    o, n = _frames(spark, [(1, "a", "a", 0.5), (2, "b", "b", 2.0)], [(1, "a", "a", 0.5), (2, "b", "b", 2.0), (2, "b", "b", 2.0)])
    assert [r[0] for r in changed_groups(o, n, ["k"]).collect()] == [2]
    assert changed_groups(o, o, ["k"]).count() == 0


def test_empty_loads_and_faults(spark):
    old, new = _loads(4, 50)
    o, n = _frames(spark, old, new)
    assert _counted(except_all(n, o.limit(0))) == Counter(new)
    assert snapshot_diff(o.limit(0), n.limit(0), keys=["k"]).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        snapshot_diff(o, n.drop("x"), columns=["k", "x"])
    with pytest.raises(ValueError, match="int"):
        snapshot_diff(o, n.withColumn("k", F.col("k").cast("string")))
    with pytest.raises(ValueError, match="keys"):
        snapshot_diff(o, n, keys=["k"], columns=["a"])


def test_rows_are_moved_only_where_they_differ(spark, tmp_path):
    """One shuffle of hashes and counts; with few differences the rows are fetched by a broadcast of their hashes."""
    from longstats.session import materialize
    wide = spark.range(20_000).select((F.col("id") % 5).cast("int").alias("k"), F.col("id").cast("string").alias("a"),
                                      F.repeat(F.lit("text "), 20).alias("b"), F.lit(0.5).alias("x"))
    old, new = materialize(wide, "old"), materialize(wide.filter("id <> 77"), "new")
    diff = snapshot_diff(old, new)
    assert [tuple(r)[:4] for r in diff.collect()] == [("removed", 1, 2, "77")]
    plan = diff._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_one_row_a_third_of_both_loads(spark):
    same = [(1, "hot", "hot", 0.5)]
    o, n = _frames(spark, same * 900 + [(2, "a", None, None)] * 900, same * 300 + [(2, "a", None, None)] * 900)
    assert sorted(map(tuple, snapshot_diff(o, n, keys=["k"]).collect())) == [("removed", 600, 1, "hot", "hot", 0.5)]


def test_rows_are_sifted_by_a_bitmap_before_they_are_joined(spark):
    """Before: with a long list of differences both tables were shuffled whole."""
    from longstats.operators.snapshot import _hashed, _maybe_in
    rows = _hashed(spark.range(20_000).withColumn("s", F.col("id").cast("string")), ["id", "s"], "id", "s")
    wanted = rows.filter(F.col("id") % 97 == 0).select("_h1", "_h2")
    got = {r["id"] for r in _maybe_in(rows, wanted).select("id").collect()}
    want = set(range(0, 20_000, 97))
    assert want <= got and len(got - want) < 20
    assert _maybe_in(rows, wanted.limit(0)).count() == 0
