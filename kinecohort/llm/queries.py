"""Queries of this package for the driver's contract, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinecohort.llm.common import held_out, learnable, pick, table
from kinecohort.llm import chat, licenses, merkle, mixing, quality, toxicity
from kinecohort.llm.decontamination import contamination
from kinecohort.llm.language import fit_languages, identify, teachable
from kinecohort.llm.repeats import remove_repeats
from kinecohort.llm.shards import read_records, write_shards
from kinecohort.llm.simhash import near_duplicates
from kinecohort.llm.tokens import count_tokens
from kinecohort.llm.whitening import whiten
from kinecohort.sources.shared import materialize


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, masked, and read back; and one made of control strings."""
    columns = "conv_id", "turn", "role", "text"
    given = pick(table(spark, sf_dir, "conversations"), *columns)
    kinds = dict(given.dtypes)
    made = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_conversations(given.union(made)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and which."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits of every document, and the verdicts of the base rules and of the latest policy."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = F.col("failures").bitwiseAND(F.lit(quality.mask(1))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", quality.passes())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    marked = near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit_toxicity(docs, labels.filter(learnable(F.col("doc_id"), 4, 2)))
    found = toxicity.score(docs, field)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part of each document lies in the shards, with the checksum of its record as read from there."""
    shards, index = write_shards(table(spark, sf_dir, "documents"))
    read = read_records(spark, shards).select(F.col("slot").alias("at"), F.crc32("ids").alias("record_crc32"))
    joined = index.join(read, index["slot"] == read["at"])
    return joined.select("doc_id", "part", "slot", "shard", "record", "start", "n_tokens", "record_crc32")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(teachable(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, weighed by the quality labels."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(mixing.with_quality(materialize(sized, "sizes"), table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest's tree, its proof, and whether what is presented of it verifies."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding, fitted on the distinct ones."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what starts earlier too."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat,
        op2_decontamination,
        op3_licenses,
        op4_quality,
        op5_simhash,
        op6_toxicity,
        op7_shards,
        op8_language,
        op9_token_counts,
        op10_mixing,
        op11_merkle,
        op12_whitening,
        op13_repeats,
    )
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.SQL, "op4_quality": quality.SQL, "op10_mixing": mixing.SQL, "op11_merkle": merkle.SQL}
