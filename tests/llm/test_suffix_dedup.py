import random
import time
from pathlib import Path

import numpy as np
import pytest

from longstats.llm import suffix_dedup
from longstats.session import checkpoint_root
from longstats.llm.suffix_dedup import common_prefixes, remove_repeats, repeated_windows, repeats, two_stage_suffix_array, window_runs

from .helpers import repeats as brute


def test_suffix_array_and_prefixes():
    random.seed(1)
    for _ in range(150):
        text = bytes(random.choice(b"ab\0\xc3") for _ in range(random.randint(1, 60)))
        array = np.frombuffer(text, np.uint8)
        sa = two_stage_suffix_array(array, 64)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for (a, b), n in zip(zip(sa, sa[1:]), common_prefixes(array, sa, 64)[1:]):
            want = next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
            assert n == want


def test_repeated_windows():
    random.seed(2)
    for _ in range(30):
        strings = [bytes(random.choice(b"ab") for _ in range(random.randint(5, 40))) for _ in range(6)]
        seen, want = set(), []
        for s in strings:
            want.append([])
            for i in range(len(s) - 4):
                if s[i:i + 5] in seen:
                    want[-1].append(i)
                seen.add(s[i:i + 5])
        assert [x.tolist() for x in repeated_windows(strings, 5)] == want


def test_runs_cover_every_window_once_and_depend_on_content_alone():
    random.seed(3)
    docs = [bytes(random.choice(b"abcdef") for _ in range(random.randint(0, 500))) for _ in range(20)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    doc, first, last, place, anchor, content = window_runs(np.frombuffer(b"".join(docs), np.uint8), starts)
    covered = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
    assert covered == [int(starts[k]) + i for k, x in enumerate(docs) for i in range(len(x) - 99)]
    for k, x in enumerate(docs):
        alone = window_runs(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert alone[4].tolist() == anchor[doc == k].tolist() and alone[5].tolist() == content[doc == k].tolist()


def corpus():
    random.seed(8)
    word = lambda n: " ".join("".join(random.choice("abcdeé") for _ in range(5)) for _ in range(n))
    passages = [word(30) for _ in range(4)] + ["license " * 30, word(14), "x" * 400]
    rows = []
    for i in range(60):
        parts = [word(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            cut = random.randint(0, 40)
            parts += [p[cut:] if random.random() < 0.4 else p, word(random.randint(0, 20))]
        rows.append((i * 7 % 61, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (104, "ab" * 300), (105, "ab" * 300 + "c"),
             (106, "short"), (-5, rows[9][1][: 150])]
    return rows


def check(spark, rows):
    got = repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, uid int").repartition(5)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert want[r["doc_id"]] == (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])


def test_against_brute_force(spark):
    check(spark, corpus())


def test_common_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BIG", 2)
    check(spark, corpus())


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    check(spark, corpus())


def test_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 1 << 12)
    check(spark, corpus())


def files(spark, shuffled=False):
    """What the session has on disk: {path: bytes} of its staged tables, or of its shuffles."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = list(manager.localDirsString()) if shuffled else [checkpoint_root(spark).removeprefix("file:")]
    found = {}
    for path in (p for root in roots for p in Path(root).rglob("shuffle_*" if shuffled else "*")):
        try:
            found[path] = path.stat().st_size if path.is_file() else 0
        except FileNotFoundError:  # removed meanwhile
            pass
    return found


def half_copied(spark):
    """Random words; one text in four comes twice."""
    random.seed(4)
    texts = [" ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(300)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:100], 1000)], "uid long, text string").repartition(4)
    return docs, texts


def test_a_full_filter_stages_no_more_than_the_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "remove_path", lambda *_: True, raising=False)
    docs, texts = half_copied(spark)
    before = files(spark)
    got = {r["uid"]: r["ranges"] for r in suffix_dedup.spans(docs).select("uid", "ranges").collect()}
    assert all(suffix_dedup.spans_of(got[1000 + i]) == [(0, len(texts[i]))] for i in range(100))
    assert not any(got[i] for i in range(400))
    staged = sum(n for path, n in files(spark).items() if path not in before)
    assert staged < sum(map(len, texts)) / 2


def test_shuffle_files_go_with_their_step(spark):
    docs, texts = half_copied(spark)
    before = files(spark, shuffled=True)
    suffix_dedup.spans(docs)  # all but the last join
    for _ in range(50):
        left = sum(n for path, n in files(spark, shuffled=True).items() if path not in before)
        if left < sum(map(len, texts)) / 10:
            break
        time.sleep(0.2)
    assert left < sum(map(len, texts)) / 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_classes_across_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(suffix_dedup, "CONTEXT_ROWS", 3)
    spark.conf.set(key, "2")
    try:
        check(spark, corpus())
    finally:
        spark.conf.set(key, before)


def test_repeated_and_missing_ids(spark):
    a, b = "a long text " * 20, "another text " * 20
    rows = [(1, a), (1, a), (1, b), (None, b), (None, None)]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"] == r["n_bytes"]) for r in got) == [
        ("1", 240, False), ("1", 240, True), ("1", 260, False), ("None", 0, True), ("None", 260, True)]


def test_texts_stay_valid(spark):
    text = "é" * 150
    rows = [(1, "x" + text, 3), (2, text + "y", 4), (3, None, 5)]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()}
    assert got[1]["text"].startswith("x") and got[2]["text"] == "y" and got[3]["text"] is None
    assert got[2]["extra"] == 4


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string"])
def test_empty_and_other_id_types(spark, schema):
    assert repeats(spark.createDataFrame([], schema)).collect() == []
    if "doc_id string" in schema:
        got = repeats(spark.createDataFrame([("b", "z" * 120), ("a", "z" * 120)], schema)).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {"a": 120, "b": 120} or {r["doc_id"]: r["n_spans"] for r in got}["b"] == 1
