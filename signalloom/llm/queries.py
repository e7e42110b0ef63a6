"""The operators of this package as queries over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import alignment, bpe, editing, imatch, packing, quality, repeats, rules, sharding, simhash, tokenfile, toxicity, turns
from signalloom.llm.tables import settle
from signalloom.llm.tokenizing import default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL that gives the same rows, where SQL can express the operator.
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), default_tokenizer())


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what stays of each document without its repeated 50-byte strings."""
    found = repeats.without_repeats(documents(spark, folder).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), default_tokenizer())


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.written_and_read(documents(spark, folder), default_tokenizer())


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards_of(documents(spark, folder), 16)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(documents(spark, folder), labels(spark, folder))[0]


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints_with_edits(documents(spark, folder))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(documents(spark, folder), labels(spark, folder))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text before and after three edits of it."""
    docs = documents(spark, folder).withColumn("edits", editing.sample_edits())
    return editing.edited_counts(docs, default_tokenizer())


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage to a quarter of its rows."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    damaged = turns.sample_damage(rows)
    audits = settle(turns.audited(damaged), "audits")
    return turns.checked(rows, audits, turns.digests(turns.repaired(damaged, audits)))


@query
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two vocabularies align in every text."""
    return alignment.report(documents(spark, folder), default_tokenizer(), alignment.default_pieces())


@query
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(documents(spark, folder), labels(spark, folder))
