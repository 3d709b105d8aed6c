import random

import numpy as np

from longstats.llm.decontaminate import FMIndex, WaveletTree, contamination, cut_words, remove_contamination, search_benchmark

from .helpers import contamination as brute


def test_wavelet_tree():
    random.seed(1)
    seq = np.array([random.randint(0, 12) for _ in range(300)])
    tree = WaveletTree(seq, 13)
    at = np.arange(300)
    assert tree.access(at).tolist() == seq.tolist()
    for s in range(13):
        for upto in (0, 1, 77, 300):
            assert tree.rank(np.array([s]), np.array([upto]))[0] == int((seq[:upto] == s).sum())


def test_index_counts_and_locates():
    random.seed(2)
    for _ in range(40):
        seq = np.array([random.randint(0, 5) for _ in range(random.randint(1, 200))])
        phrases = [tuple(random.randint(1, 5) for _ in range(random.randint(1, 3))) for _ in range(15)]
        rows, lengths = np.zeros((15, 3), np.int32), np.array([len(p) for p in phrases])
        for i, p in enumerate(phrases):
            rows[i, 3 - len(p):] = p
        index = FMIndex(seq, 6)
        for p, lo, hi in zip(phrases, *index.search(rows, lengths)):
            want = [k for k in range(len(seq) - len(p) + 1) if tuple(seq[k:k + len(p)]) == p]
            assert (sorted(index.locate(np.arange(lo, hi)).tolist()) if hi > lo else []) == want


def tables(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(12)] + ["Ähre", "don't", "x_y"]
    say = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, say(random.choice((1, 2, 9, 10, 14)))) for i in range(8)] + [(8, None), (9, "..."), (3, "w1 w2 w3 w4 w5"), (None, "w1 w1 w1")]
    docs = [(i, say(random.randint(0, 200))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "!!!"), (50, "w1"), (53, items[4][1].upper() + "," + items[5][1]), (54, "w1 " * 3000)]
    return (spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, __spans int"),
            spark.createDataFrame(items, "item_id long, text string"), docs, items)


def test_against_brute_force(spark):
    docs, bench, rows, items = tables(spark)
    want = sorted(map(str, brute(rows, items)))
    for block in (1 << 20, 40):
        got = contamination(docs.repartition(3), bench, block_bytes=block).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. One, two three four five six seven eight nine TEN eleven! After", "a"),
                                  (2, "one two three four five six seven eight nine", "b"), (3, None, "c")],
                                 "doc_id long, text string, __items string")
    more = bench.unionByName(spark.createDataFrame([(2, "Before one")], "item_id long, text string"))
    for items, first in ((bench, "Before. ! After"), (more, "! After")):
        for block in (1 << 20, 30):
            got = remove_contamination(docs, items, block_bytes=block)
            assert got.columns == docs.columns
            assert {r["doc_id"]: r["text"] for r in got.collect()} == {
                1: first, 2: "one two three four five six seven eight nine", 3: None}


def test_cut_words():
    assert cut_words("a b c d", [[1, 3]]) == "a  d"


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = contamination(docs, bench).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (1, 0, False)
    assert contamination(docs.limit(0), bench).collect() == []
    assert remove_contamination(docs, bench).collect() == docs.collect()
    assert search_benchmark(docs.limit(0), bench).count() == 0
