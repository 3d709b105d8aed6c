import numpy as np
import pytest
from pyspark.sql import functions as F

from longstats.llm import hash_forest
from longstats.llm.hash_forest import nearest

SCHEMA = "vec_id long, embedding array<float>, cid int"


def brute(rows, k=20):
    """{query id: lists of its rows}; every valid row is a candidate, whatever its id."""
    valid = []
    for i, e, _ in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            valid.append((i, np.array(e, np.float32).astype(float)))
    out = {}
    for a, (q, x) in enumerate(valid):
        if q % 20 == 0:
            scores = sorted((-float(np.dot(x, y)), i) for b, (i, y) in enumerate(valid) if a != b and len(y) == len(x))
            out.setdefault(q, []).append([(i, -s) for s, i in scores[:k]])
    return out


def recall(found, want):
    """Share of the brute-force neighbours found; ids that occur once."""
    hits = sum(len(found.get(q, set()) & {i for i, _ in near}) for q, [near] in want.items())
    return hits / sum(len(near) for [near] in want.values())


def vectors(n=400, dim=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x *= rng.uniform(0.2, 3.0, (n, 1)).astype(np.float32)
    x[50:130] = x[50]  # a large group of copies
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    order = rng.permutation(40).tolist()
    rows += [(2000, [1.0, 1.0, 0.0], 1)] + [(2001 + n, [float(i), 40.0 - float(i), 1.0], 1) for n, i in enumerate(order)]  # all tie
    rows += [(1000, None, 1), (1020, [], 1), (1040, [0.0] * dim, 1), (1060, [1.0] * (dim - 1) + [None], 1),
             (1080, [float("nan")] * dim, 1), (1100, [float("inf")] + [1.0] * (dim - 1), 1), (None, [1.0] * dim, 1),
             (1120, [1.0, 2.0], 1), (1121, [2.0, 1.0], 1), (20, rows[20][1], 1),
             (40, [float(v) for v in x[41]], 1), (40, [float(v) for v in x[42]], 1), (7, [float(v) for v in x[60]], 1)]
    return rows


def test_exact_when_candidates_are_all(spark):
    rows = vectors()
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert got.keys() == want.keys() and len(want[40]) == 3 and len(want[20]) == 2
    for q, lists in want.items():
        assert sorted(r for r, _, _ in got[q]) == sorted(r + 1 for near in lists for r in range(len(near)))
        found = sorted((r, round(s, 9), i) for r, i, s in got[q])
        assert found == sorted((r + 1, round(s, 9), i) for near in lists for r, (i, s) in enumerate(near))


def test_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), SCHEMA)
    want = sorted(map(str, nearest(df, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(hash_forest, "BLOCK", 30)
    assert sorted(map(str, nearest(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_recall_with_few_candidates(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * 2
    x = (centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 32)) * 0.5).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(3000)]
    found = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, candidates=6000).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert recall(found, want) >= 0.9


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_does_not_hang_on_the_candidates_given(spark):
    """Unstructured vectors, and far too few candidates asked for: the sampled queries say how many are needed."""
    x = np.random.default_rng(8).uniform(-1, 1, (2000, 24)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(2000)]
    found = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, candidates=50).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert recall(found, want) >= 0.9


def test_enough_takes_the_smallest_number():
    sizes = {1: {0: 100, 1: 50, 2: 10}, 2: {0: 100, 1: 60, 2: 20}}
    assert hash_forest.enough({1: [2, 2], 2: [2, 2]}, sizes, 1.0) == 10
    assert hash_forest.enough({1: [2, 2], 2: [1, 2]}, sizes, 1.0) == 50
    assert hash_forest.enough({1: [2, 0], 2: [1, 2]}, sizes, 1.0) == 60
    assert hash_forest.enough({}, {}, 0.9) == 0
