"""The corpus pipeline: five operators of ``healthloom.llm`` over ``documents``, one after the other.

Each stage works on all that its predecessor kept.  Stages but the last return
the columns of documents; the last returns packed sequences, piece by piece.
Each result is written as Parquet and read again as the next one's documents.

Defined cases: null texts are empty texts, judged, deduplicated and packed like
others (of several, one is left after exact dedup; the mix takes none, as it has
no words); null ids and repeated rows are rows like any other, and of equal rows
one is left; ties go as each operator says; a very long text goes through whole
and is cut only by the packing; an empty table gives an empty result; further
columns of documents, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from healthloom.llm import digest_index, entry, mixing, nearcopies, packing, quality
from healthloom.llm.common import checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return digest_index.exact_dedup(docs, keep="max")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return nearcopies.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on the line is cut there."""
    return mixing.mixed_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids."""
    return packing.pack_documents(docs, entry.tokenizer_path(), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mix", mixed),
    ("pack", packed),
]

#: A fitted model, SimHash over XXH64 and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
