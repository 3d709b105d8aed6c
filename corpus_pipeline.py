"""The corpus pipeline: five operators of ``longstats.llm`` in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next stage's docs.  All but the last return the columns of
``documents``; the last returns the mix: one row per document with its words,
its source's target, the words that the mix takes and its training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longstats.llm.common import read_table, stage
from longstats.llm.decontaminate import remove_contamination
from longstats.llm.mixing import mixed
from longstats.llm.quality import keep_good
from longstats.llm.simhash import keep_one
from longstats.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return keep_one(docs, shingle=4, distance=4)


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings go; their first occurrence stays."""
    return _recounted(remove_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark phrases go."""
    return _recounted(remove_contamination(docs, read_table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix, in the order of training positions."""
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: SQL can't express the fitted classifier, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
