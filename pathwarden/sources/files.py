"""CSV, JSON, GeoJSON and GraphML by Spark's own readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tried in this order; the first under which the header decodes cleanly is used.
ENCODINGS = ("UTF-8", "MS949", "EUC-KR")


def first_match(spark: SparkSession, folder: str, pattern: str) -> str:
    """The first file by name in ``folder`` that matches, wherever Spark can list."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in found or [])
    if not names:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return names[0]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of text columns with a header, in UTF-8 (with or without mark) or a Korean code page."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("head"))
    heads = [bytes(r["head"]) for r in raw.limit(64).collect()]
    for e in ENCODINGS:
        try:
            for h in heads:
                h[: len(h) if len(h) < 1 << 16 else h.rfind(b"\n") + 1 or len(h)].decode({"MS949": "cp949"}.get(e, e))
        except UnicodeDecodeError:
            continue
        df = spark.read.option("header", True).option("encoding", e).option("multiLine", e != "UTF-8").csv(path)
        return df.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns])
    raise ValueError(f"{path} is in none of {ENCODINGS}")


def try_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """As :func:`read_csv`; None where it fails."""
    try:
        return read_csv(spark, path)
    except Exception:  # noqa: BLE001  any failure means that there is no such dataset
        return None


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """A CSV with a header; with ``bom`` each file starts with the mark that spreadsheets look for."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}")
    df.write.mode("overwrite").option("header", True).csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: geometry type, coordinates as JSON text, and the properties as a map."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_points(features: DataFrame, key: str = "osmid") -> DataFrame:
    """Point features (lon, lat) once for each ``key``; repeated keys keep the least position."""
    xy = F.from_json("coordinates", "array<double>")
    p = features.where("type = 'Point'").select(F.col("properties")[key].alias(key), xy[0].alias("lon"), xy[1].alias("lat"), "properties")
    return p.groupBy(key).agg(F.min_by(F.struct("lon", "lat", "properties"), F.struct("lon", "lat")).alias("p")).select(key, "p.*")


def geojson_rings(features: DataFrame, name: str) -> DataFrame:
    """The outer rings of polygons as (name, ring array<struct<x,y>>), a row for each part of a multipolygon."""
    one = features.where("type = 'Polygon'").select(F.col("properties")[name].alias(name), F.from_json("coordinates", "array<array<array<double>>>").alias("c"))
    many = features.where("type = 'MultiPolygon'").select(F.col("properties")[name].alias(name), F.explode(F.from_json("coordinates", "array<array<array<array<double>>>>")).alias("c"))
    return one.unionByName(many).select(name, F.transform(F.col("c")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def write_geojson(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """Features, one a line; what reads whole documents can read the lines."""
    from pathwarden.operators.reports import feature_rows

    feature_rows(df, lon, lat).write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file, attributes under their names as text."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = {r["_id"]: r["_attr.name"] for r in keys.collect()}
    data = "data array<struct<_key:string,_VALUE:string>>"

    def part(tag: str, fields: str, own: list[str]) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", tag).schema(f"{fields}, {data}").load(path)
        bag = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: F.struct(x["_key"], x["_VALUE"])))
        df = df.withColumn("_m", bag)
        return df.select(*[F.col(c).alias(c.lstrip("_")) for c in own], *[F.col("_m")[k].alias(n) for k, n in names.items() if n not in [c.lstrip("_") for c in own]])

    nodes = part("node", "_id string", ["_id"]).withColumnRenamed("id", "node")
    edges = part("edge", "_source string, _target string, _id string", ["_source", "_target", "_id"]).withColumnsRenamed({"source": "u", "target": "v", "id": "key"})
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``nodes`` (node, ...) and ``edges`` (u, v, key, ...) as GraphML lines; nulls are left out.

    The folder's parts, one after another, are one document: head, nodes by id, edges by ends, tail.  :func:`read_graphml` reads the folder.
    """
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    kinds = {"double": "double", "float": "float", "int": "int", "bigint": "long", "boolean": "boolean"}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    made = []
    for kind, df, own in (("node", nodes, ["node"]), ("edge", edges, ["u", "v", "key"])):
        more = [(f"{kind[0]}{i}", c, t) for i, (c, t) in enumerate(x for x in df.dtypes if x[0] not in own)]
        names = [(k, c.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;"), t) for k, c, t in more]
        head += [f'<key id="{k}" for="{kind}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for k, c, t in names]
        data = [F.coalesce(F.concat(F.lit(f'<data key="{k}">'), escaped(F.col(f"`{c}`")), F.lit("</data>")), F.lit("")) for k, c, _ in more]
        ends = {"node": [F.lit('<node id="'), escaped(F.col("node"))], "edge": [F.lit('<edge source="'), escaped(F.col("u")), F.lit('" target="'), escaped(F.col("v")), F.lit('" id="'), escaped(F.coalesce(F.col("key").cast("string") if "key" in df.columns else F.lit("0"), F.lit("0")))]}[kind]
        made.append(df.select(F.lit(1 + len(made)).alias("_k"), F.concat_ws("\u0001", *(F.col(c).cast("string") for c in own if c in df.columns)).alias("_o"), F.concat(*ends, F.lit('">'), *data, F.lit(f"</{kind}>")).alias("value")))
    spark = nodes.sparkSession
    frame = lambda k, lines: spark.createDataFrame([(k, f"{i:04d}", x) for i, x in enumerate(lines)], "_k int, _o string, value string")
    lines = frame(0, [*head, '<graph edgedefault="directed">']).unionByName(made[0]).unionByName(made[1]).unionByName(frame(9, ["</graph>", "</graphml>"]))
    lines.orderBy("_k", "_o", "value").select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet under one path."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as JSON text in one file, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def upsert_report(spark: SparkSession, report: dict, path: str) -> None:
    """One dataset's entry replaced: an overwritten partition of a table by dataset."""
    row = spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str), report["dataset"])], "report string, dataset string")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def relative_paths(report, base: str):
    """A report's texts that lie below ``base``, told from there; everything else as it is."""
    if isinstance(report, dict):
        return {k: relative_paths(v, base) for k, v in report.items()}
    if isinstance(report, (list, tuple)):
        return [relative_paths(v, base) for v in report]
    root = base.rstrip("/") + "/"
    return report[len(root) :] if isinstance(report, str) and report.startswith(root) else report


def _below(spark: SparkSession, pattern: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.globStatus(p) or []]


def clean_artifacts(spark: SparkSession, folder: str, patterns: list[str], dry_run: bool = False) -> list[str]:
    """What matches ``patterns`` below ``folder``, deleted (unless ``dry_run``); patterns that lead out of it are refused."""
    gone = []
    for pattern in patterns:
        if pattern.startswith("/") or ".." in pattern.split("/") or not pattern.strip("*/. "):
            raise ValueError(f"not below the folder: {pattern}")
        fs, found = _below(spark, f"{folder.rstrip('/')}/{pattern}")
        for p in found:
            if dry_run or fs.delete(p, True):
                gone.append(p.toString())
    return sorted(gone)


def reclean(spark: SparkSession, path: str, reports: str | None = None) -> dict[str, dict]:
    """Stored datasets (``path/dataset=NAME``, Parquet) cleaned again by their schemas, in place; report by dataset.

    A dataset is cleaned into a stored copy first.  If that has the rows that are there already, its files stay untouched, as do those of other
    datasets.  Rows that went through cleaning aren't winsorised a second time.
    """
    from dataclasses import replace

    from pathwarden.operators.quality import SCHEMAS, clean_points
    from pathwarden.storage import cut

    out = {}
    for name, schema in SCHEMAS.items():
        _, found = _below(spark, f"{path}/dataset={name}")
        if not found:
            continue
        was = spark.read.parquet(f"{path}/dataset={name}")
        done = "_preprocessing_version" in was.columns
        clean, report = clean_points(was, name, replace(schema, nonnegative=()) if done else schema)
        clean = cut(clean.drop("_row_ord") if "_row_ord" not in was.columns else clean)
        told = [c for c in clean.columns if c != "_processed_at_utc"]
        same = set(clean.columns) == set(was.columns) and not clean.select(told).exceptAll(was.select(told)).limit(1).count() and not was.select(told).exceptAll(clean.select(told)).limit(1).count()
        if not same:
            clean.write.mode("overwrite").parquet(f"{path}/dataset={name}")
        if reports:
            upsert_report(spark, report, reports)
        out[name] = report | {"changed": not same}
    return out
