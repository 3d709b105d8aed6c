import random

from longstats.llm.toxicity import (AIMED, DENIED, INSULT, MENACE, NOT, OTHER, QUOTED, SAID, WEIGHTS, WHOM, Scorer, Transducer,
                                    grammar, learn_lexicon, scored, word_features)


def test_composition_is_the_two_in_a_row():
    a = Transducer([{0: (0, 1, 0.5), 1: (1, 0, 0.0)}, {0: (1, 0, 0.0), 1: (0, 1, 1.0)}])
    b = Transducer([{0: (1, 7, 1.0), 1: (0, 8, 0.0)}, {0: (0, 9, 2.0), 1: (1, 7, 0.25)}])
    both = a.compose(b)
    for word in ([0, 0, 1, 1, 0], [1, 0, 1, 0, 0, 1], []):
        middle = a.run(word)
        last = b.run([s for s, _ in middle])
        assert both.run(word) == [(s, w + v) for (_, w), (s, v) in zip(middle, last)]


def test_grammar():
    run = lambda *symbols: grammar().run(list(symbols))
    assert run(OTHER, INSULT)[1] == (INSULT, WEIGHTS[INSULT])
    assert run(WHOM, OTHER, INSULT)[2] == (AIMED, WEIGHTS[AIMED])
    assert sum(w for _, w in run(INSULT, OTHER, WHOM)) == WEIGHTS[AIMED]
    assert sum(w for _, w in run(INSULT, OTHER, OTHER, OTHER, WHOM)) == WEIGHTS[INSULT]
    assert run(NOT, OTHER, INSULT)[2] == (DENIED, WEIGHTS[DENIED])
    assert run(SAID, OTHER, OTHER, OTHER, OTHER, INSULT)[5] == (QUOTED, WEIGHTS[QUOTED])
    assert sum(w for _, w in run(MENACE, WHOM)) > sum(w for _, w in run(MENACE, OTHER, OTHER, OTHER, WHOM))


def test_clauses_not_words():
    s = Scorer({"idiot$": 2.0})
    assert s.strength("you are an idiot") > s.strength("what an idiot") > s.strength("you are not an idiot") > 0
    assert s.strength("she said. what an idiot") == s.strength("what an idiot") > s.strength("he said what an idiot")
    assert s.strength("I will kill you") > s.strength("they kill time")
    assert s.strength("") == s.strength(None) == s.strength("nice text. you!") == 0


def tables(spark):
    random.seed(4)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("lan", "mor", "tes")]
    docs, labels = [], []
    for i in range(600):
        text = [random.choice(words) for _ in range(random.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(random.randrange(len(text)), random.choice(["Dolt", "jerk", "zugg" + random.choice(words)]))
        docs.append((i, " ".join(text), 1.0))
        if i % 3:
            labels.append((i, int(toxic)))
    docs += [(700, None, 1.0), (701, "", 1.0), (None, "x", 1.0), (5, "twice", 1.0), (702, "jerk " * 20000, 1.0)]
    labels += [(1, 0), (None, 1), (2, None), (9999, 1)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels, d, la = tables(spark)
    got = scored(d, la).collect()
    assert len(got) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and all(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held)
    assert sorted(map(str, scored(d.repartition(3), la).collect())) == sorted(map(str, got))


def test_long_words_and_many_rounds(spark):
    """Whole words of 60 characters that only their endings tell apart, and five kinds of words, each rarer than the last."""
    stem = "quiet" + "q" * 50
    assert f"{stem}bad$" in word_features(f"a {stem}bad")
    docs, labels, n = [], [], 0
    for kind, copies in enumerate((200, 90, 40, 18, 8)):
        for k in range(copies):
            docs.append((n, f"plain words {stem}{'abcde'[kind]} go on {k}"))
            labels.append((n, 1))
            n += 1
    for k in range(600):
        docs.append((n, f"plain words {stem}z go on {k}"))
        labels.append((n, 0))
        n += 1
    got = scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    told = dict(labels)
    assert all(r["predicted"] == told[r["doc_id"]] for r in got)


def test_lexicon_is_not_cut():
    counts = [(f"w{i}$", 50, 0) for i in range(7000)]
    assert len(learn_lexicon(counts, 100, 5000, 4)) == 7000


def test_held_out_labels_are_not_used(spark):
    _, labels, d, la = tables(spark)
    import zlib

    flipped = [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    again = scored(d, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted(map(str, again)) == sorted(map(str, scored(d, la).collect()))


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in scored(d, none).collect()] == [0, 0]
    assert scored(d.limit(0), none).collect() == []
