"""Corpus preparation from `documents` to a mix, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleflow.llm import bwt, cube, jaccard, quality, winnow
from bundleflow.llm.common import cut, read, small_batches

SHINGLE, PERCENT = 5, 80  # near duplicates: word shingles of five, Jaccard similarity of 0.8 and more


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, accepts."""
    scored = quality.classify(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.filter(F.col(scored.columns[-1])["predicted"] == 1).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    small_batches(spark)
    return jaccard.first_of_groups(docs, shingle=SHINGLE, percent=PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeats that stand earlier; n_chars follows.

    A cut inside a character leaves the replacement character.
    """
    small_batches(spark)
    found = bwt.dedup(docs)
    left = F.expr(f"make_valid_utf8(cast(`{found.columns[-1]}`.kept AS string))")
    changed = F.col(found.columns[-1])["n_removed"] > 0
    kept = found.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    small_batches(spark)
    judged = winnow.scan(docs, read(spark, sf_dir, "benchmark"))
    return judged.filter(F.col(judged.columns[-1])["n_hit"] == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: the columns of cube.mix."""
    small_batches(spark)
    return cube.mix(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_clean),
    ("mixing sources", mix_sources),
]
ORACLE_SQL = None  # the classifier is trained, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
