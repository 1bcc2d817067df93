"""From raw documents to token shards: stages that each read what the one before wrote.

All but the last return the columns of documents. Documents without an id cannot be named by a decision about ids: they
pass the stages that go by ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinecohort.llm.common import table
from kinecohort.llm.decontamination import decontaminate
from kinecohort.llm.language import fit_languages, keep_known
from kinecohort.llm.mixing import mixed_rows
from kinecohort.llm.shards import write_shards
from kinecohort.llm.simhash import keep_one
from kinecohort.sources.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others, and those without letters, go."""
    return keep_known(docs, fit_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of 3-word shingles are linked by up to two differing bits."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs, table(spark, sf_dir, "labels"))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; returned is the place of each part of each document in them."""
    return write_shards(docs)[1]


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: Fingerprints, languages and permutations are not SQL; the stages are tested against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
