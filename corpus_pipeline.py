"""A training-corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import langid, mixing, packing, pii, simhash
from tracklane.llm.common import dropped, fold, shared_dir
from tracklane.llm.queries import vocabulary

#: A document is rejected if its text has no letters or if over this share of its trigrams is noise in any language.
MOST_NOISE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, texts without letters, and those that are mostly noise. Null keys
    are learned from, repeated rows are judged alike, and an empty table gives none."""
    model = langid.learned(docs.where(fold(docs.doc_id, 3) != 1), "text", "lang")
    judged = docs.withColumn("__language", langid.predictor(docs, model)(docs.text))
    return judged.where((F.col("__language.lang") != "und") & (F.col("__language.noise") <= MOST_NOISE)).drop("__language")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles have a similarity of 0.8 or more (odd rows:
    simhash.deduplicated)."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by their kind (odd rows: pii.redacted)."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents so that sources come near their target shares (odd rows: mixing.mixed)."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of each document, with its sequence and offset (odd rows: packing.packed)."""
    return packing.packed(docs, vocabulary())


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("best_fit_packing", packed)]

#: SQL can express none of the stages but mixing; tests hold each stage's operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        dropped(spark, last)  # the stage before has been read for the last time
        docs, last = spark.read.parquet(path), [path]
    return docs
