import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from longstats.llm import bloom_lm
from longstats.llm.bloom_lm import LEVEL_COUNT, LEVELS, PAIR, WORD, Filter, fill_segment, level_of, score

from .helpers import base_scores


def test_levels():
    counts = np.arange(1, 5000)
    levels = level_of(counts)
    assert levels[:4].tolist() == [1, 2, 3, 4] and (np.diff(levels) >= 0).all()
    assert (np.abs(LEVEL_COUNT[levels] - counts) / counts < 0.2).all()
    assert LEVEL_COUNT[0] == 0 and len(LEVEL_COUNT) == len(LEVELS) + 1


def test_filter_never_misses_and_rarely_adds():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(1, 50, 3000)
    bits = 1 << 19
    data = np.frombuffer(fill_segment([(WORD, keys, counts)], bits, 1), np.uint8)
    found = Filter(data, 1)
    assert (found.count(WORD, keys) >= LEVEL_COUNT[level_of(counts)]).all()
    assert (found.count(WORD, keys) == LEVEL_COUNT[level_of(counts)]).mean() > 0.98
    assert (found.count(PAIR, keys) == 0).mean() > 0.98


def corpus():
    random.seed(9)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(random.choices(words, weights=[1 / (k + 1) for k in range(200)], k=random.randint(0, 80)))) for i in range(300)]
    rows += [(1000 + i, "The same Ä sentence comes again and again") for i in range(20)]
    return rows + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "unseen " * 50), (2004, "a\u00a0b")]


@pytest.mark.parametrize("frequent", [1 << 20, 20, 0])
def test_base_scores_are_exact(spark, frequent):
    rows = corpus()
    got = score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"), bits=1 << 20, frequent=frequent).collect()
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = base_scores(rows, lambda i: not part(i))
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, part(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0


def test_the_model_learns_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), bits=1 << 20).collect()}
    assert all(got[i]["score"] > got[i]["base_score"] + 3 for i in range(1000, 1020))


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, words = bloom_lm.train(docs, bits=1 << 20)
    keys = np.array([r["key"] for r in words.collect()], np.int64).view(np.uint64)
    for before in range(0, len(keys), 40):
        code = np.arange(len(keys))
        p = 10 ** model.log10_probability(keys, code, np.full(len(keys), before))
        assert 0.9 < p.sum() < 1.1


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), bits=1 << 16).collect()
    assert len(got) == 4 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_empty_and_untrained(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string"), bits=1 << 16).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = score(spark.createDataFrame([(held, "a")], "doc_id long, text string"), bits=1 << 16).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 2)


def test_no_pair_is_dropped_for_size(spark):
    """A pair seen once is known, however few bits are broadcast, and both ways give the same scores."""
    rows = corpus() + [(3000, "once seen"), (3001, "never met")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = next(1 << k for k in range(14, 24) if bloom_lm.train(docs, bits=1 << k)[0].filter is not None)
    whole = {r["doc_id"]: r.asDict() for r in score(docs, bits=least).collect()}
    for frequent in (1 << 20, 300, 0):
        cut_up = {r["doc_id"]: r.asDict() for r in score(docs, bits=1 << 10, frequent=frequent).collect()}
        assert cut_up.keys() == whole.keys()
        for i, row in whole.items():
            assert {k: v for k, v in cut_up[i].items() if "score" not in k} == {k: v for k, v in row.items() if "score" not in k}
            assert cut_up[i]["score"] == pytest.approx(row["score"], abs=1e-6)
            assert cut_up[i]["base_score"] == pytest.approx(row["base_score"], abs=1e-6)


def test_pairs_seen_once_count(spark):
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [i for i in range(40) if not part(i)]
    held = [i for i in range(40, 80) if part(i)][:2]
    rows = [(i, f"x{i} y{i}") for i in train] + [(held[0], f"x{train[0]} y{train[0]}"), (held[1], f"x{train[0]} y{train[1]}")]
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 0.5


def test_the_filter_grows_with_the_counts():
    sizes = [bloom_lm.segment_bits(n) for n in (0, 10, 10**6)]
    assert sizes[0] < sizes[1] < sizes[2] and all(8 * n <= s for s, n in zip(sizes, (0, 10, 10**6)))
    assert bloom_lm.filter_segments(0) == bloom_lm.SEGMENTS < bloom_lm.filter_segments(10**10) < bloom_lm.filter_segments(10**11)


def test_no_filter_exceeds_its_bound(spark):
    """Short words seen once fill the filter most."""
    rows = [(i, " ".join(chr(0x61 + (i + k) % 26) for k in range(400))) for i in range(60)] + [(100 + i, "") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = bloom_lm.train(docs)
    assert 8 * len(model.filter.data) <= bloom_lm.most_bits(sum(len(t) for _, t in rows), len(rows), model.filter.segments)


def exact_scores(rows, mu=bloom_lm.MU):
    """(doc_id, text) -> {id: score} of the same model with whole counts instead of levels."""
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"] for i, t in rows}
    words = Counter(w for i, ws in tokens.items() if not part(i) for w in ws)
    pairs = Counter(p for i, ws in tokens.items() if not part(i) for p in zip(["\n", *ws], ws))
    n, v = sum(words.values()), len(words)
    p1 = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    return {i: sum(math.log10((pairs[a, b] + mu * p1(b)) / (words[a] + mu)) for a, b in zip(["\n", *ws], ws))
            for i, ws in tokens.items()}


@pytest.mark.parametrize("bits", [1 << 28, 1 << 10])
def test_scores_against_whole_counts(spark, bits):
    """Levels stand for counts within a fifth, and few absent n-grams are found: scores differ by little a token."""
    rows = corpus()
    want = exact_scores(rows)
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    off = [abs(r["score"] - want[r["doc_id"]]) / r["n_tokens"] for r in got]
    assert max(off) < 0.3 and np.mean(off) < 0.03


def test_very_long_and_hot_texts(spark):
    """A text longer than a chunk, and one text in a third of all rows."""
    long = " ".join(f"word{i % 90_000}" for i in range(600_000))
    rows = [(0, long), *((i, f"a{i} b{i % 7}") for i in range(1, 200)), *((i, "the same words") for i in range(200, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = base_scores(rows, lambda i: not part(i))
    got = score(docs, bits=1 << 10).collect()
    assert len(long) > bloom_lm.CHUNK_BYTES and len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
