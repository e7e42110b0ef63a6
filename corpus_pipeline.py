"""From raw documents to packed training sequences, in five stages.

Every stage reads all documents the one before it kept and returns the columns of
``documents``; the last one returns the packed pieces. Rows are told apart by their key
and their text, so rows that repeat a key are each judged by their own text. A stage that
drops documents removes the rows it names and leaves all others, with all their columns,
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import packing, repeats, rules, similar, toxicity
from signalloom.llm.tables import phase, settle
from signalloom.llm.tokenizing import default_tokenizer

#: Tokens of a packed sequence.
SEQUENCE = 2048
#: A hash of each row's text travels with its key.
MARK = "__text_hash"


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(MARK, F.xxhash64("text"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a[MARK].eqNullSafe(b[MARK])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    marked = _marked(docs)
    rejected = rejected.select("doc_id", MARK).distinct()
    return marked.join(rejected, _same_row(marked, rejected), "left_anti").select(*docs.columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    with phase(spark):
        found, _ = rules.judged(_marked(docs), _labels(spark, sf_dir), also=[MARK])
        rejected = settle(found.where("not kept").select("doc_id", MARK), "rejected", outlives=True)
    return _without(docs, rejected)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the models learn from what is left of the labelled ones."""
    with phase(spark):
        found = toxicity.scored(_marked(docs), _labels(spark, sf_dir), also=[MARK])
        rejected = settle(found.where("predicted = 1").select("doc_id", MARK), "rejected", outlives=True)
    return _without(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest key stays, once.

    Near are texts of a Jaccard similarity of at least 0.8 over five-word shingles.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", MARK)
    with phase(spark):
        found = settle(similar.groups(_marked(docs), width=5, similarity=0.8, also=[MARK]), "groups")
        first = found.groupBy("root").agg(F.min(order).alias("first"))
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col(MARK).eqNullSafe(F.col(f"first.{MARK}"))
        later = settle(found.join(first, "root").where(~stays).select("doc_id", MARK), "later", outlives=True)
        repeated = not found.groupBy("doc_id", MARK).count().where("count > 1").isEmpty()
    kept = _without(docs, later)
    if repeated:
        kept = _marked(kept).dropDuplicates(["doc_id", MARK])
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document of smaller key also has leave the text."""
    with phase(spark):
        found = repeats.without_repeats(docs, decoded=True)
        changed = {"text": F.when(F.col("text").isNotNull(), F.col("kept"))}
        if "n_chars" in docs.columns:
            kind = dict(docs.dtypes)["n_chars"]
            changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("n_chars"))
        # Settled here, so that the shuffled slices go at once and not when the next stage is done.
        return settle(found.withColumns(changed).select(*docs.columns), "shortened", outlives=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most ``SEQUENCE`` tokens."""
    return packing.pack(docs, default_tokenizer(), SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: Learned rules, models and token ids have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with phase(spark):
            docs = settle(stage(spark, docs, sf_dir), name, outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
