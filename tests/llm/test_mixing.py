import pytest
from pyspark.sql import functions as F

from longstats.llm.mixing import DEFAULT_SCHEDULES, curriculum, integral, inverse_demand, mixed, plan_mix

from .helpers import SPACED, mix

SCHEMA = "doc_id long, text string, source string, size string, rank int"


def rows():
    out = []
    for i in range(60):
        source = None if i % 11 == 0 else "bca"[i % 3] if i < 50 else "tiny"
        out.append((i, " ".join(f"w{k}" for k in range(i % 9 * (40 if source == "a" else 3))), source, "x", 1))
    out += [(100, None, "b", "x", 1), (101, " \t\n ", "b", "x", 1), (102, "a\u00a0b c\x0bd", "é", "x", 1),
            (7, "again", "b", "x", 1), (7, "again", "b", "x", 1), (None, "no id", "b", "x", 1), (103, "", "empty", "x", 1)]
    return out


def test_targets_and_taken(spark):
    data = rows()
    got = mixed(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    want = mix([(r[0], r[2], r[1]) for r in data])
    source = {}
    for r in data:
        source.setdefault((r[0], len(SPACED.findall(r[1] or ""))), r[2])
    taken = dict.fromkeys(want, 0)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == want[s][0]
        assert r["target"] == pytest.approx(want[s][1])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[s] += r["taken"]
    for s, (_, target) in want.items():
        assert taken[s] == round(target) or abs(taken[s] - target) <= 0.5


def test_reruns_agree_and_rows_are_sorted(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = mixed(df).collect(), mixed(df.repartition(5)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    positions = [r["position"] for r in a if r["position"] is not None]
    assert positions == sorted(positions)


def test_schedules_integrate_and_invert(spark):
    assert [integral(k) for k in DEFAULT_SCHEDULES] == [1.0, 2.0, 3.0]
    for knots in (*DEFAULT_SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))):
        total = integral(knots)
        got = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", inverse_demand(F.col("u"), knots).alias("t"))
        for r in got.collect():
            done = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                t = min(max(r["t"], t0), t1)
                w = w0 + (w1 - w0) * (t - t0) / (t1 - t0)
                done += (t - t0) * (w0 + w) / 2
            assert done / total == pytest.approx(r["u"], abs=1e-9)


def test_curriculum_order_follows_the_schedule(spark):
    data = [(i, "w " * 10, "a") for i in range(100)] + [(100 + i, "w " * 10, "b") for i in range(100)]
    plan = plan_mix(spark.createDataFrame(data, "doc_id long, text string, source string"),
                    schedules=(((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))))
    copies = curriculum(plan).collect()
    assert sum(r["words"] for r in copies) == 2000
    half = [r["source"] for r in copies if r["position"] < 0.5]
    assert half.count("a") > 2.5 * half.count("b")


def test_bad_schedules(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string")
    for knots in (((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError):
            plan_mix(df, schedules=(knots,))


def test_empty(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    plan = mixed(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
