"""Registered queries of the operators; every one reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import score
from .common import read_table
from .decontaminate import contamination
from .divergence import divergence
from .hash_forest import nearest
from .mixing import mixed
from .oracles import ORACLES
from .page_text import main_text
from .pii import personal_data
from .quality import judged
from .resample import resample
from .simhash import near_duplicates
from .suffix_dedup import repeats
from .toxicity import scored
from .url_rules import url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents"))


def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths their languages: what the documents tell of where they come from."""
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                  host=F.col("source"), path=F.col("lang"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_rules": op1_url_rules,
    "op2_mixing": op2_mixing,
    "op3_page_text": op3_page_text,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_hash_forest": op6_hash_forest,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_personal": op11_personal,
    "op12_resampling": op12_resampling,
    "op13_divergence": op13_divergence,
}

__all__ = ["ORACLES", "QUERIES"]
