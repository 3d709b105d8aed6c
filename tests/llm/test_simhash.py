import random

import pyspark.sql.functions as F

from longstats.llm import simhash
from longstats.llm.simhash import components, keep_one, links, near_duplicates

from .helpers import fingerprint, linked


def texts():
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for g in range(12):
        base = [random.choice(words) for _ in range(random.choice((3, 60, 400)))]
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            if random.random() < 0.6:
                copy[random.randrange(len(copy))] = random.choice(words)
            out.append(" ".join(copy).title() if random.random() < 0.3 else "  ".join(copy))
    return out + ["", None, " \t", "one", "ONE", "two words", "Ä ö ü", "a\u00a0b c d e", "x " * 5000]


def test_against_brute_force(spark):
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts())]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = {i: fingerprint(t) for i, t, _ in rows}
    want = linked(prints)
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def near_fingerprints():
    random.seed(6)
    out = set()
    for _ in range(30):
        x = random.getrandbits(64)
        out.add(x)
        for _ in range(12):
            y = x
            for b in random.sample(range(64), random.randint(1, 6)):
                y ^= 1 << b
            out.add(y)
            x = y if random.random() < 0.3 else x
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def connected(spark, blocks):
    fps = near_fingerprints()
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    labels = components(links(df, 4, blocks), df.select(F.col("fp").alias("node")))
    got = {r["node"]: r["label"] for r in labels.collect()}
    want = linked({signed(x): x for x in fps})
    groups = {}
    for node, label in want.items():
        groups.setdefault(label, set()).add(node)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(n for n, x in got.items() if x == label) for label in set(got.values())}
    assert all(label == min(n for n, x in got.items() if x == label) for label in set(got.values()))


def test_links_connect_what_links(spark):
    connected(spark, 3)
    connected(spark, 2)
    connected(spark, 5)


def test_anchors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    connected(spark, 3)


def test_a_large_group_costs_links_in_proportion(spark):
    random.seed(7)
    x = random.getrandbits(62)
    fps = {x}
    while len(fps) < 600:
        y = x
        for b in random.sample(range(64), 2):
            y ^= 1 << b
        fps.add(y)
    found = links(spark.createDataFrame([(signed(y),) for y in fps], "fp long")).count()
    assert 599 <= found < 600 * 60  # of 179,700 pairs


def test_keep_one(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    want = linked({i: fingerprint(t) for i, t, _ in rows})
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_keep_one_with_odd_ids(spark):
    long_ = " ".join(f"a{i}" for i in range(50))
    other = " ".join(f"b{i}" for i in range(50))
    rows = [(1, long_), (1, long_), (1, other), (None, long_), (None, "c d e f"), (None, "c d e f"), (2, other)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(r["doc_id"], r["text"]) and r for r in got]))
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted([(1, long_), (1, other), (None, "c d e f")], key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []
