"""An extension: cleaning as points arrive, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathwarden.operators.quality import PointSchema, clean_points


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def clean_stream(stream: DataFrame, name: str, schema: PointSchema, out: str, checkpoint: str, order: str = "_row_ord") -> StreamingQuery:
    """Each batch cleaned and written under its number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, n: int) -> None:
        clean, _ = clean_points(df, name, schema, order=order)
        clean.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind; what is later than ``late`` no longer counts."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
