"""A corpus from raw documents to packed sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm import decontaminate, lines, near, packing, toxicity
from lidarlake.llm.common import read, stored
from lidarlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar (learned on the labels) rejects go; a row without an id is judged as well."""
    labels = read(spark, sf_dir, "labels")
    grammar = toxicity.Grammar.learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return toxicity.filter_clean(docs, grammar)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the first alone; a document of which nothing else is left goes.

    Documents that were empty or null before stay. Nulls in other columns, repeated rows and very long texts go through as they are."""
    out = lines.dedup_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near.keep_one(docs, size=5, least=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end=2, capacity=1024, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned weights, templates, minhash candidates and packing plans are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
