"""Cleaning again in place, refreshes with drift, GraphML both ways, clean-up and the commands for them."""

import os

import pytest
from pyspark.sql import functions as F

from pathwarden.__main__ import main
from pathwarden.sources import files as S
from pathwarden.streaming import refresh


def test_cleaning_again_changes_nothing(spark, tmp_path):
    rows = [(str(i % 40), 36.3 + i / 1000, 127.4, f" name  {i} ", i) for i in range(60)] + [("x", 127.4, 36.3, "swapped", 99)]
    df = spark.createDataFrame(rows, "sn string, latitude double, longitude double, name string, _row_ord long")
    bumps = spark.createDataFrame([(str(i), 36.3, 127.4, float(i**3)) for i in range(50)], "SDHP_SN string, LATITUDE double, LONGITUDE double, height double")
    path = str(tmp_path / "raw")
    df.write.parquet(f"{path}/dataset=school_zone")
    bumps.write.parquet(f"{path}/dataset=speed_bump")
    spark.range(3).write.parquet(f"{path}/dataset=other")
    first = S.reclean(spark, path, str(tmp_path / "reports"))
    assert set(first) == {"school_zone", "speed_bump"} and all(r["changed"] for r in first.values())
    assert first["school_zone"]["duplicate_rows_removed"] == 20 and spark.read.parquet(f"{path}/dataset=school_zone").count() == 41
    stamp = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    before = stamp()
    again = S.reclean(spark, path, str(tmp_path / "reports"))
    assert not any(r["changed"] for r in again.values()) and stamp() == before
    assert {r["dataset"] for r in spark.read.parquet(str(tmp_path / "reports")).collect()} == {"school_zone", "speed_bump"}
    more = spark.read.parquet(f"{path}/dataset=school_zone").limit(1).withColumn("sn", F.lit("new"))
    more.write.mode("append").parquet(f"{path}/dataset=school_zone")
    spark.createDataFrame([("new", 36.31, 127.41, "n")], "sn string, latitude double, longitude double, name string").write.mode("append").parquet(f"{path}/dataset=school_zone")
    changed = S.reclean(spark, path)
    assert changed["school_zone"]["changed"] and not changed["speed_bump"]["changed"]


def test_refreshes_drift_and_restart(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    schema = "dataset string, k long"

    def arrive(**counts):
        rows = [(d, k) for d, n in counts.items() for k in range(n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        refresh.refresh_stream(stream, "dataset", out, state).awaitTermination()

    arrive(a=100, b=10)
    arrive(a=105, b=12)
    arrive(a=105)
    arrive(a=80, b=13)
    want = {("a", 0): False, ("b", 0): False, ("a", 1): False, ("b", 1): True, ("a", 2): False, ("a", 3): True, ("b", 3): False}
    verdicts = lambda: {(r["dataset"], r["batch"]): r["drift"] for r in spark.read.parquet(out).collect()}
    assert verdicts() == want
    # The last batch again, as after a crash before its commit.
    commits = os.path.join(state, "commits")
    for f in os.listdir(commits):
        if f.strip(".").split(".")[0] == "3":
            os.remove(os.path.join(commits, f))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
    refresh.refresh_stream(stream, "dataset", out, state).awaitTermination()
    assert verdicts() == want


def test_graphml_both_ways(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1.5, 'x "q" & <y>'), ("b", None, None)], "node string, x double, name string")
    edges = spark.createDataFrame([("a", "b", "0", 7.0), ("b", "a", "1", None)], "u string, v string, key string, length double")
    path = str(tmp_path / "g")
    S.write_graphml(nodes, edges, path)
    n, e = S.read_graphml(spark, path)
    assert {r["node"]: (r["x"], r["name"]) for r in n.collect()} == {"a": ("1.5", 'x "q" & <y>'), "b": (None, None)}
    assert {(r["u"], r["v"], r["key"]): r["length"] for r in e.collect()} == {("a", "b", "0"): "7.0", ("b", "a", "1"): None}
    from xml.etree import ElementTree

    whole = b"".join((tmp_path / "g" / f).read_bytes() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert len(ElementTree.fromstring(whole)) == 4


def test_clean_up(spark, tmp_path):
    for f in ("a.tmp", "b.tmp", "keep.csv"):
        (tmp_path / f).write_text("x")
    assert len(S.clean_artifacts(spark, str(tmp_path), ["*.tmp"], dry_run=True)) == 2 and (tmp_path / "a.tmp").exists()
    assert main(["clean-artifacts", str(tmp_path), "*.tmp"]) == 0
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["keep.csv"]
    for bad in ("/etc/*", "../x", "*"):
        with pytest.raises(ValueError):
            S.clean_artifacts(spark, str(tmp_path), [bad])
    assert S.relative_paths({"a": ["/base/x/y", "/other"], "b": 3, "c": {"d": "/base/z"}}, "/base") == {"a": ["x/y", "/other"], "b": 3, "c": {"d": "z"}}


def test_algorithm_command(spark, tmp_path):
    from pathwarden.sources.remote import demo_graph

    demo_graph(spark)[1].write.parquet(str(tmp_path / "edges"))
    spark.createDataFrame([("N2_0", "N2_4")], "origin string, destination string").write.parquet(str(tmp_path / "pairs"))
    assert main(["evaluate-algorithms", str(tmp_path / "edges"), str(tmp_path / "pairs"), str(tmp_path / "out")]) == 0
    got = spark.read.parquet(str(tmp_path / "out" / "certification")).collect()
    assert {r["mode"] for r in got} == {"shortest", "safest", "balanced"} and all(r["proven_rate"] == 1.0 for r in got)


def test_models_are_stored_as_values():
    from pathwarden.operators import boosting as B
    import json

    import numpy as np

    tree = B.Tree(np.array([0, -1, 1]), np.array([3, 0, 5]), np.array([0.1, 0.0, -0.2, 0.4]), np.arange(7.0))
    m = B.Model(B.Fit(7, (1,)), 2.5, np.array([1, 2], np.uint8), None, [tree])
    again = B.Model.from_dict(json.loads(json.dumps(m.to_dict(["a", "b"]))))
    x = np.random.default_rng(0).integers(0, 9, (50, 2)).astype(np.uint8)
    assert (m.probability(x) == again.probability(x)).all() and again.fit == m.fit
