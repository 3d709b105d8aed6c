import random

import pytest
from pyspark.sql import functions as F

from longstats.llm import divergence as module
from longstats.llm.divergence import _term_blocks, divergence, share_of

from .helpers import LOWER, TERMS
from .helpers import divergence as brute

SCHEMA = "text string, lang string, source string, term string, rank int, p long"


def rows(n=400, seed=3, sources=7):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ä", "ß", "日本", "don't", "x_Y9z"]
    out = []
    for _ in range(n):
        lang = rng.choice(("en", "en", "de", None))
        k = 0 if rng.random() < 0.4 else rng.randrange(sources)  # a hot source
        own = words[:20 + 8 * k]
        out.append((" ".join(rng.choice(own) for _ in range(rng.randint(0, 40))), lang, None if k == 6 else f"s{k}"))
    out += [(None, "en", "silent"), ("", "en", "silent"), ("123 !!", "en", "digits"), ("rare words only", "fr", "a"), ("others", "fr", "b"),
            (None, None, None), ("rare", "it", "only"), ("wa wb", "en", "s1"), ("wa wb", "en", "s1")]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [500_000, 40])
def test_against_brute_force(spark, block):
    data = rows()
    got = divergence(frame(spark, data).repartition(6), block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert told(got) == brute(data)


def test_small_dictionaries_and_scatters_change_nothing(spark, monkeypatch):
    data = rows(200, 9)
    monkeypatch.setattr(module, "REMEMBERED", 10)
    monkeypatch.setattr(module, "SCATTERED", 3)
    assert told(divergence(frame(spark, data), min_docs=5, top=3)) == brute(data, 5, 3)


def test_ties_go_by_name(spark):
    data = [("aa bb", "x", s) for s in ("é", "z", "Z", "a") for _ in range(10)] + [("bb cc", "x", "b")] * 40
    got = told(divergence(frame(spark, data)))
    assert got == brute(data)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "b" and r[2] == "pair"] == ["Z", "a", "z", "é"]


def test_empty_and_tiny_tables(spark):
    assert divergence(frame(spark, rows())).count() and divergence(frame(spark, rows()).limit(0)).count() == 0
    few = [("one", "en", "a"), ("two", "en", "b"), (None, None, None)]
    assert told(divergence(frame(spark, few))) == brute(few) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts(spark):
    data = rows(150, 5) + [("Wa wb " * 300_000, "en", "s1"), ("q" * 2_000_000, "en", "s2")]
    assert told(divergence(frame(spark, data), min_docs=10)) == brute(data, 10)


def test_blocks_cut_nothing():
    rng = random.Random(1)
    text = "".join(rng.choice("abZ9 .é-\n[`") for _ in range(4000)) + "x" * 300
    for size in (1, 13, 10**6):
        assert [w.decode() for b in _term_blocks(text, size) for w in b] == TERMS.findall(text.translate(LOWER))


def test_shares_are_exact_for_large_counts(spark):
    cases = [(10**15 + 7, 3 * 10**15, 10**6), (0, 0, 3), (5, 0, 0), (9_223_372_036_854, 9_300_000_000_000, 12_345)]
    got = spark.createDataFrame(cases, "n long, total long, terms long").select(share_of(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else 0 for n, t, v in cases]


def test_no_pair_of_postings_leaves_a_task(spark):
    """What the accumulation gives is one row per pair of sources and block, however many terms they share."""
    import pandas as pd
    block = pd.DataFrame({"lang": "x", "part": 0, "t": [t for t in range(5000) for _ in range(4)], "g": list(range(4)) * 5000,
                          "p": range(20_000), "base": [1, 2, 3, 4] * 5000})
    out = module.accumulate(block)
    assert len(out) == 12 and set(zip(out.g, out.h)) == {(g, h) for g in range(4) for h in range(4) if g != h}
