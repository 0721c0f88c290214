"""Tables of results for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, query: str | None, district: str | None = None, k: int = 10) -> DataFrame:
    """The first ``k`` places, by name and address, whose name or address holds ``query``, case aside."""
    out = df if district is None else df.where(F.col("district") == district)
    if query:
        q = query.lower()
        out = out.where(F.lower("name").contains(q) | F.coalesce(F.lower("address").contains(q), F.lit(False)))
    return out.orderBy("name", "address").limit(k)


def gates(metrics: DataFrame) -> DataFrame:
    """``metrics`` (roc_auc, ap_lift, f1) with the verdicts of the research and regional gates."""
    return metrics.withColumns({"research_gate": (F.col("roc_auc") >= 0.70) & (F.col("ap_lift") >= 2), "regional_gate": F.col("f1") >= 0.5})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).count()


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by hash order: a sampling operator, the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def hash_order(key: str, seed: int = 42):
    """An order that SQL can repeat: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def map_summary(classified: DataFrame, route_edges: DataFrame | None = None) -> DataFrame:
    """Counts and shares of risk classes, and how many of each are on a route (edge_id)."""
    d = classified if route_edges is None else classified.join(route_edges.select("edge_id").distinct().withColumn("_on", F.lit(1)), "edge_id", "left")
    on = F.lit(0) if route_edges is None else F.coalesce(F.col("_on"), F.lit(0))
    total = d.groupBy("risk_class").agg(F.count("*").alias("n"), F.sum(on).alias("on_route"), F.min("risk_score").alias("least"), F.max("risk_score").alias("most"))
    everything = d.agg(F.count("*").alias("_n"))
    return total.join(F.broadcast(everything), F.lit(True)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def feature_rows(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """GeoJSON features, one a row, for a map."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def markdown(df: DataFrame, k: int = 100) -> str:
    """A table of the first ``k`` rows."""
    rows = df.limit(k).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
