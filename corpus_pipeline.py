"""From raw documents to packed training sequences.

Each stage takes and returns documents with all their columns; the last returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweb.llm import language, mixing, near_dedup, packing, pii
from siltweb.llm.common import materialize, table

#: Dropped ids up to this many are named to every task; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, how: language.Training = language.Training()) -> DataFrame:
    """Documents in a language that the field is sure enough of; a missing ``lang`` is filled in. Those without letters go."""
    labelled = language.identify(docs, language.train(docs, how))
    kept = labelled.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= how.min_score))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, how: near_dedup.NearDup = near_dedup.NearDup()) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of rows that repeat id and text, one."""
    judged = near_dedup.near_duplicates(docs, how)
    # An id alone doesn't tell rows apart: it may be null or repeat with another text.
    keyed = docs.withColumn("_text_key", near_dedup.text_key(F.col("text")))
    gone = materialize(judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    twice = keyed.groupBy(F.col("doc_id").alias("_id"), F.col("_text_key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_id", "_key")
    twice = materialize(twice, "twice")
    gone, twice = (F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (gone, twice))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_key").eqNullSafe(F.col("_key"))
    left = keyed.join(gone, same, "left_anti")
    once = left.join(twice, same, "left_anti")
    repeated = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(repeated).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the mixture's weights."""
    return mixing.mix(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the field's labels nor the sampled signatures can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
