"""A training corpus from raw documents: quality, near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. What
the operators' docstrings define for nulls, empty and very long texts, ties, repeated rows,
empty tables and other columns holds for the stages; the first three return the columns of
``docs`` with the input's values, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm import jaccard_join, mixing, packing, quality
from sleuthframe.llm.common import Scratch, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = unused(docs.columns, "score", "predicted")
    judged = quality.classify(docs, model, score_col=score, predicted_col=predicted)
    return judged.where(F.col(predicted) == 1).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return jaccard_join.keep_one(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their raked probabilities, mixing.KEEP of the tokens."""
    return mixing.sample(docs, keep=mixing.KEEP)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences."""
    pieces = packing.pack(docs)
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "window", "step_group")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("mixture", mix_to_targets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the stage before wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
