"""Refreshes judged as they arrive: counts by dataset, and whether they drift from the refresh before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def judge(counts: DataFrame, before: DataFrame, most: float = 0.10) -> DataFrame:
    """(dataset, before, after, drift) of ``counts`` (dataset, after) beside ``before`` (dataset, before).

    A count drifts if it changes by more than a share; any change from nothing is drift, a first count isn't.
    """
    j = counts.join(before, "dataset", "left")
    change = F.abs(F.col("after") - F.col("before")) / F.col("before")
    return j.select("dataset", "before", "after", F.when(F.col("before").isNull(), False).when(F.col("before") == 0, F.col("after") > 0).otherwise(change > most).alias("drift"))


def latest(spark: SparkSession, out: str, until: int | None = None) -> DataFrame:
    """(dataset, before): the last count of each dataset, of refreshes before ``until``."""
    schema = "dataset string, before long, after long, drift boolean, batch long"
    try:
        seen = spark.read.schema(schema).parquet(out)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], schema)
    seen = seen if until is None else seen.where(F.col("batch") < until)
    return seen.groupBy("dataset").agg(F.max_by("after", "batch").alias("before"))


def refresh_stream(stream: DataFrame, dataset: str, out: str, checkpoint: str, most: float = 0.10) -> StreamingQuery:
    """Each batch's rows counted by ``dataset`` and held against the counts of the batches before.

    The state is the table of verdicts itself, a partition a batch.  A batch that runs again after a restart reads only earlier
    ones and replaces its own, so its verdicts are the same.
    """

    def batch(df: DataFrame, n: int) -> None:
        counts = df.groupBy(F.col(dataset).cast("string").alias("dataset")).agg(F.count(F.lit(1)).alias("after"))
        judge(counts, latest(df.sparkSession, out, n), most).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
