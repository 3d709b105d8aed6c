import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from longstats.llm.common import stage
from longstats.llm.resample import bracket, bucket_counts, draw_cutoff, feature_blocks, gains, resample, resampled, word_blocks

from .helpers import LOWER, WORDS, drawn

SCHEMA = "doc_id long, text string, rank string, uid int, score string"


def rows(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Ähre", "x_y", "don't", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 19, 20, 21, 60))))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " \t!"), (5, docs[5][1]), (5, docs[5][1]), (None, "w1 " * 30), (n + 3, "WORD " * 25)]
    goal = [(i, " ".join(rng.choice(words[:20]) for _ in range(30))) for i in range(10)] + [(None, None)]
    return docs, goal


def frames(spark, docs, goal):
    return (spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA), spark.createDataFrame(goal, "item_id long, text string"))


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ngram,buckets", [(1, 10000), (1, 7), (3, 500)])
def test_against_brute_force(spark, ngram, buckets):
    docs, goal = rows()
    df, target = frames(spark, docs, goal)
    got = resample(df.repartition(5), target, buckets=buckets, ngram=ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = drawn(docs, goal, buckets, ngram=ngram)
    assert [r[:4] for r in told(got)] == [r[:4] for r in want]
    # equal rows may take each other's rank
    assert sorted((r[:1] + r[4:] for r in told(got) if r[4]), key=str) == sorted((r[:1] + r[4:] for r in want if r[4]), key=str)


@pytest.mark.parametrize("share", [Fraction(0), Fraction(1, 1000), Fraction(1, 2), Fraction(999, 1000), Fraction(1)])
def test_any_share(spark, share):
    docs, goal = rows(120)
    df, target = frames(spark, docs, goal)
    want = drawn(docs, goal, share=(share.numerator, share.denominator))
    assert sorted(r[4] for r in told(resample(df, target, share=share)) if r[4]) == sorted(r[4] for r in want if r[4])


def test_blocks_cut_nothing():
    rng = random.Random(1)
    text = "".join(rng.choice("abZ9 .é-\n") for _ in range(5000)) + "x" * 400
    want = WORDS.findall(text.translate(LOWER))
    for size in (1, 7, 100, 10**6):
        assert [w.decode() for b in word_blocks(text, size) for w in b] == want
        grams = sorted(f for _, fs in feature_blocks(text, 3, size) for f in fs)
        assert grams == sorted(" ".join(want[i:i + n]).encode() for n in (1, 2, 3) for i in range(len(want) - n + 1))


def test_bracket_is_widened_until_the_counts_agree(spark):
    scores = stage(spark.range(10_000).select((F.col("id") * 3).alias("score"), F.col("id").alias("doc_id"), F.col("id").alias("uid")), "t")
    # a sketch of other numbers: it proposes wrongly at first
    wrong = spark.range(10_000).select((F.col("id") + 100_000).alias("score")).agg(F.kll_sketch_agg_bigint("score")).first()[0]
    for k in (1, 700, 5000, 10_000):
        low, high, above, inside = bracket(scores, 10_000, k, bytes(wrong))
        assert above < k <= above + inside
        assert draw_cutoff(scores, Fraction(k, 10_000)) == (k, 3 * (10_000 - k), 10_000 - k)
    right = scores.agg(F.kll_sketch_agg_bigint("score")).first()[0]
    low, high, above, inside = bracket(scores, 10_000, 1000, bytes(right))
    assert inside < 1500  # only the bracket is sorted


def test_ties_and_a_third_of_all_rows_on_one_id(spark):
    # no text differs, ids repeat: equal scores everywhere
    docs = [(i % 200 if i % 3 else 7, "same text again " * 10) for i in range(900)]
    df, target = frames(spark, docs, [(1, "same")])
    got = told(resample(df, target))
    ranks = [r[4] for r in got if r[4]]
    assert sorted(ranks) == list(range(1, 91))
    want = drawn(docs, [(1, "same")])
    assert sorted((r[0], r[4]) for r in got if r[4]) == sorted((r[0], r[4]) for r in want if r[4])
    no_ids = spark.createDataFrame([(None, f"t{i} " * 25) for i in range(300)] + [(i, f"t{i} " * 25) for i in range(100)], "doc_id long, text string")
    assert resampled(no_ids, target).count() == 40


def test_empty_tables_and_long_texts(spark):
    docs, goal = rows(60)
    df, target = frames(spark, docs, goal)
    assert resample(df.limit(0), target).count() == 0
    alone = told(resample(df, target.limit(0)))
    assert alone == drawn(docs, [])
    assert all(r[4] is None for r in told(resample(df.limit(3), target)))
    big = [(1, "long Word " * 400_000), (2, "x" * 3_000_000)] + docs[:40]
    df, target = frames(spark, big, goal)
    assert told(resample(df, target)) == drawn(big, goal)


def test_gains():
    s, t = np.array([0, 3, 5]), np.array([2, 0, 5])
    want = [math.floor(1000 * math.log((b + 1) * (8 + 3) / ((a + 1) * (7 + 3)))) for a, b in zip(s, t)]
    assert gains(s, t).tolist() == want


def test_counts_are_summed_over_tasks(spark):
    docs, _ = rows(100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert bucket_counts(df.repartition(7), 50).tolist() == bucket_counts(df.coalesce(1), 50).tolist()
