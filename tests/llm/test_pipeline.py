import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import contamination, fingerprint, linked, mix, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas()}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), f"test-{name}")
        out[name] = docs.toPandas()
    return out


def test_stage_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "mix"]
    for name in ("quality", "near_duplicates", "repeats", "decontamination"):
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_quality_drops_labelled_junk(stages):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    kept = set(stages["quality"].doc_id)
    told = [(labels[i], i in kept) for i in stages["documents"].doc_id if i in labels.index]
    assert sum(bool(q) == k for q, k in told) / len(told) > 0.95


def test_near_duplicates(stages):
    before = stages["quality"]
    want = set(linked({i: fingerprint(t) for i, t in zip(before.doc_id, before.text)}).values())
    assert set(stages["near_duplicates"].doc_id) == want and len(stages["near_duplicates"]) == len(want)


def test_repeats(stages):
    before, after = stages["near_duplicates"], stages["repeats"].set_index("doc_id")
    want = repeats(zip(before.doc_id, before.text))
    for i, text in zip(before.doc_id, before.text):
        n, gone, spans, _ = want[i]
        # a cut inside a character takes its other bytes along
        assert n - gone - 6 * spans <= len(after.text[i].encode()) <= n - gone
        assert after.n_chars[i] == len(after.text[i])


def test_decontamination(stages):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    before, after = stages["repeats"], stages["decontamination"].set_index("doc_id")
    for i, words, hit, *_ in contamination(zip(before.doc_id, before.text), zip(items.item_id, items.text)):
        left = contamination([(i, after.text[i])], [])[0][1]
        assert left == words - hit


def test_mix(stages, spark):
    before, after = stages["decontamination"], stages["mix"]
    want = mix(zip(before.doc_id, before.source, before.text))
    rows = after.merge(before[["doc_id", "source"]], on="doc_id")
    assert len(rows) == len(before)
    for source, part in rows.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(want[source][1])
        assert abs(part.taken.sum() - want[source][1]) <= 0.5
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, got.fillna(-1).values.tolist())) == sorted(map(tuple, after.fillna(-1).values.tolist()))


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words in a short text", "en", None, 27),
            (3, "plain words in a short text", "en", None, 27), (None, "no id " * 30, None, "s", 180), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema).withColumn("kept", F.lit(1)).withColumn("score", F.lit(1)).withColumn("fp", F.lit(1))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_oracles_match(spark):
    import duckdb

    from longstats.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from read_parquet('{t}')")
    for name, sql in ORACLES.items():
        want, got = con.execute(sql).df(), QUERIES[name](spark, SF).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
        assert got.equals(want.astype(got.dtypes.to_dict()))


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert str(Path(corpus_pipeline.__file__).parent) in sys.path
