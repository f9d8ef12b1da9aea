"""Corpus pipeline: language ID, near-duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the
columns of ``documents``; the last is the mix's manifest, one row per document
with how often and how many words of it are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlake.llm import chosen_path, decontam, lang_bitmask, mixing, pii_feistel
from wardlake.llm.common import documents
from wardlake.session import remove_path, scratch_path

TRAIN_DOCS = 20_000
#: Key of the pseudonyms; a deployment sets its own.
PII_SECRET = "pseudonyms of the corpus pipeline"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language stay; a missing lang is filled in."""
    return lang_bitmask.identified(docs, lang_bitmask.fit(lang_bitmask.labelled(docs, TRAIN_DOCS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates stays."""
    return chosen_path.firsts(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages (a twentieth of their words) go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms of the same format."""
    return pii_feistel.replaced(docs, PII_SECRET)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that the sources meet their targets."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("pii", pseudonymised), ("mixing", mixed)]

#: Language ID and the near-duplicate groups are not SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage before is no longer read
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
