"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage takes all documents that the one before kept and returns the columns of
documents; the last returns doc_id, source and the tokens.  Filtering stages keep
every document that they don't reject; documents with null texts stay until mixing,
which takes nothing of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathwarden.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from pathwarden.llm.common import discard, kept_tables, release, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs.select("doc_id", "source", "text"), pieces.load(), ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: SQL can express neither learned scores nor pseudorandom mixing; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), kept_tables()
    base = f"{shared_dir(spark).rstrip('/')}/pathwarden/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        # Nothing reads the stage before or the operator's own tables any more.
        release(spark, but=before)
        if k:
            discard(spark, f"{base}/{k - 1}")
    return docs
