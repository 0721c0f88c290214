"""Helpers shared by the operators: durable intermediate tables and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_FALLBACK = "/tmp/checkpoints/pathwarden"
_kept: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one stands in only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or LOCAL_FALLBACK


def fresh(names: Iterable[str], name: str) -> str:
    """``name``, lengthened until none of ``names`` is alike (case aside, as Spark sees it)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor.  The second
    value is the path, for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pathwarden/{label}-{uuid.uuid4().hex}"
    _kept.append(path)
    # Once the table is written, the shuffle files behind it are of no more use.
    was = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, was)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`stored` wrote, through the file system they are in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _kept:
            _kept.remove(path)


def kept_tables() -> list[str]:
    """The paths of the tables that stand behind results returned so far."""
    return list(_kept)


def release(spark: SparkSession, but: Iterable[str] = ()) -> None:
    """Delete all stored tables except ``but``: for when the results that read them have been written or are no longer wanted."""
    discard(spark, *set(_kept).difference(but))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, component) of every node in ``edges``; component is its smallest node.

    Each round lowers a node's label to the least label among its neighbours and
    then follows labels of labels, so the number of rounds grows with the
    logarithm of a component's diameter.  Every round is stored.  Nothing but the
    number of changed labels reaches the driver.  Also returns the path of the
    stored result.
    """
    spark = edges.sparkSession
    both, both_path = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct(),
        "links",
    )
    labels, path = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        lowered = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jumped = lowered.join(labels.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c", "left").select(
            "node", "was", F.least("c", F.coalesce("cc", "c")).alias("component")
        )
        after, after_path = stored(jumped, "labels")
        changed = after.where("was <> component").limit(1).count()
        discard(spark, path)
        labels, path = after.select("node", "component"), after_path
        if not changed:
            discard(spark, both_path)
            return labels, path
