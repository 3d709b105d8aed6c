import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from longstats.llm.quality import MOST_WORTH, features, fit, judged, keep_good, site_priors


def tables(spark, n=600):
    random.seed(2)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am") for b in ("em", "sum", "or", "et", "ix")]
    docs, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randint(5, 80))]
        good = i % 7 != 0
        if not good:
            text = [random.choice(([w + "%%%" for w in text], [w.upper() + "!!" for w in text], [text[0]] * len(text), ["|".join(text)]))[0:]][0]
        docs.append((i, " ".join(text), "en", "hot" if i % 3 else f"s{i % 5}", 5))
        if i % 2:
            labels.append((i, int(good)))
    docs += [(900, None, None, None, 5), (901, "", "en", "hot", 5), (3, docs[3][1], "en", "hot", 5), (None, "lorem ipsum", "en", "hot", 5)]
    labels += [(1, 1), (None, 0), (4, None)]
    return (docs, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, quality int"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_rejects_the_bad_and_keeps_the_good(spark):
    docs, d, la = tables(spark)
    got = judged(d, la, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(docs)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 600}
    assert sum(kept[i] == (i % 7 != 0) for i in kept) / len(kept) > 0.99
    assert all(kept[i] for i in kept if i % 7)
    out = keep_good(d, la, F.col("source"), F.col("lang"))
    assert out.columns == d.columns
    assert out.count() == sum(r["kept"] for r in got)


def test_reruns_agree(spark):
    _, d, la = tables(spark)
    a, b = (judged(x, la, F.col("source"), F.col("lang")).collect() for x in (d, d.repartition(6)))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_fit_finds_the_direction():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 3))
    y = (x[:, 0] * 2 - x[:, 1] + rng.logistic(size=2000) > 0).astype(float)
    w, _, _, _ = fit(x, y)
    assert w[0] == pytest.approx(2, abs=0.4) and w[1] == pytest.approx(-1, abs=0.3) and abs(w[2]) < 0.3


def test_priors_shrink_by_size(spark):
    sites = [("big", "p", 1000.0, 900.0), ("big", "q", 2.0, 0.0), ("bad", "p", 800.0, 80.0), ("one", "p", 1.0, 0.0), (None, None, 3.0, 3.0)]
    got = {(r["p_host"], r["p_path"]): r["prior"] for r in site_priors(
        spark.createDataFrame(sites, "host string, path string, n double, good double")).collect()}
    assert len(got) == 5 and all(0 < p < 1 for p in got.values())
    assert got["big", "p"] == pytest.approx(0.9, abs=0.02)
    assert got["bad", "p"] == pytest.approx(0.1, abs=0.02)
    assert got["big", "p"] > got["big", "q"] > got["bad", "p"]  # two documents don't outweigh the host
    assert 0.1 < got["one", "p"] < 0.6
    assert MOST_WORTH > 100


def test_features_are_bounded(spark):
    texts = [None, "", " ", "a", "%" * 1000, "A" * 1000, "x " * 30000, "a|b|c", "ÄÖ ß 123 ! \n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        *[c.alias(k) for k, c in features(F.col("text")).items()]).collect()
    assert all(v is not None and 0 <= v < 1001 for r in rows for v in r)


def test_repeats_count_at_any_length(spark):
    word = "a" * 100
    texts = [(f"{word} {word}",), (f"{word} {word}a",), (f"x{word} {word}",), ("b" * 300_000 + " " + "b" * 300_000,)]
    got = [r[0] for r in spark.createDataFrame(texts, "text string").select(features(F.col("text"))["f_repeats"]).collect()]
    assert got == [100 / 201, 0.0, 0.0, 300_000 / 600_001]


def test_no_labels_and_empty(spark):
    docs, d, la = tables(spark, 20)
    assert judged(d, la.limit(0), F.col("source"), F.col("lang")).where("kept").count() == len(docs)
    assert judged(d.limit(0), la, F.col("source"), F.col("lang")).count() == 0
    assert keep_good(d.limit(0), la, F.col("source"), F.col("lang")).columns == d.columns
