"""A corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from shroudline.llm import packing, pii, simhash, substrings, toxicity
from shroudline.llm.common import ensure_checkpoint_dir, recount, table
from shroudline.sources.sinks import Files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the score is learned from the labelled rows outside the held-out fold."""
    ensure_checkpoint_dir(spark)
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return simhash.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the texts; n_chars follows. Every document stays."""
    return recount(substrings.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows. Every document stays."""
    return recount(pii.mask(docs, pii.trained()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the stages: they learn from labels, hash with a gear table and use a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared checkpoint folder and read again, and goes once the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = posixpath.join(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            Files(spark, before).remove(before)
        before = path
    return docs
