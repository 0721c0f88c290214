"""The operators' queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathwarden.llm import forest, html_text, jaccard_join, line_dedup, merkle, mixing, mpeg, packing, pieces, resampling, sharding, sql, toxicity, warc
from pathwarden.llm.common import table


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.op1_forest(table(spark, sf_dir, "embeddings"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_mix(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op3_pieces(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op4_html(table(spark, sf_dir, "pages"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op5_lines(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op6_jaccard(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.op7_media(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op9_warc(table(spark, sf_dir, "pages"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op10_shard(table(spark, sf_dir, "documents"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op11_pack(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.op12_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_merkle(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_forest, op2_mix, op3_pieces, op4_html, op5_lines, op6_jaccard, op7_media, op8_toxicity, op9_warc, op10_shard, op11_pack, op12_resample, op13_merkle]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
