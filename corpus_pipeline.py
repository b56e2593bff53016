"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, source mixing, best-fit packing.

Each stage works on all rows that its predecessor kept; its result is written
as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from repolens.llm import line_dedup, mixing, packing, simhash, toxicity
from repolens.llm.shared import table
from repolens.plans.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier flags."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on ten sites or more (the first place keeps them)."""
    ensure_checkpoint_dir(spark)
    return line_dedup.drop_spread_lines(docs, min_sites=10, min_words=1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ensure_checkpoint_dir(spark)
    return simhash.one_per_group(docs, shingle=4, seed=42, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: copies and parts of documents by the quotas of their sources."""
    ensure_checkpoint_dir(spark)
    return mixing.mixed_documents(docs, weights=(1, 2, 3), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ensure_checkpoint_dir(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), most=2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_dedup", drop_near_copies),
          ("source_mix", mix_sources), ("best_fit_packing", pack_sequences)]

#: Classifier, fingerprints and packing are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
