"""The final evaluation's parts and files, the ends of a pilot route, datasets collected in one call, and the demonstration's features."""

import json

import pytest

from pathwarden.__main__ import main
from pathwarden.operators import evaluation as E
from pathwarden.operators import schools
from pathwarden.sources import files, remote, workbook

NESTED = "district string, region_x int, accident_label int, nested_oof_probability double, nested_oof_prediction int, nested_decision_threshold double"


def _regions(spark):
    rows = [(f"D{i % 2}", i, int(i % 4 == 0), 0.9 - i % 4 * 0.2 - i * 0.001, int(i % 4 == 0 or i % 10 == 1), 0.5 + i % 2 * 0.1) for i in range(40)]
    return rows, spark.createDataFrame(rows, NESTED)


def test_nested_predictions_are_judged(spark):
    rows, df = _regions(spark)
    d = E.judged(df)
    got = E.overall(d).first()
    tp, fp = sum(1 for r in rows if r[2] and r[4]), sum(1 for r in rows if not r[2] and r[4])
    assert (got["tp"], got["fp"], got["fn"], got["positives"], got["n"]) == (tp, fp, 0, 10, 40)
    assert abs(got["threshold"] - 0.55) < 1e-9 and got["roc_auc"] == 1.0 and abs(got["ap_lift"] - 4) < 1e-9
    per = {r["district"]: r for r in E.by_district(d).collect()}
    # Odd regions have no positive: no ranking there.
    assert per["D0"]["positives"] == 10 and per["D0"]["f1"] == 1.0 and per["D1"]["roc_auc"] is None and per["D1"]["f1"] == 0.0


def test_gates(spark):
    _, df = _regions(spark)
    d = E.judged(df)
    region, districts = E.overall(d), E.by_district(d)
    state = lambda **k: {r["area"]: r["state"] for r in E.safety_gates(region, districts, **k).collect()}
    bare = state()
    assert bare["ranking"] == "good" and bare["missed_risk"] == "conditional" and bare["seed_stability"] == "poor" and bare["routes"] == "conditional" and bare["temporal"] == "poor"
    seeds = spark.createDataFrame([(7, 0.6), (17, 0.52)], "seed int, f1_at_shared double")
    routes = spark.createDataFrame([(8, 1.0, 12.5, 0, True)], "evaluated long, positive_share double, median_reduction double, exceeded long, stable boolean")
    split = spark.createDataFrame([(0.8, 0.1, 0.2)], "roc_auc double, brier double, dummy_brier double")
    full = state(seeds=seeds, routes=routes, split=split)
    assert full["seed_stability"] == "good" and full["routes"] == "good" and full["temporal"] == "conditional"
    assert {r["state"]: r["areas"] for r in E.state_counts(E.safety_gates(region, districts)).collect()} == {"good": 1, "conditional": 3, "poor": 5}
    empty = E.judged(df.limit(0))
    assert {r["area"]: r["state"] for r in E.safety_gates(E.overall(empty), E.by_district(empty)).collect()}.get("ranking", "poor") == "poor"


def test_command_writes_everything(spark, tmp_path):
    _, df = _regions(spark)
    df.write.parquet(str(tmp_path / "in" / "regions"))
    files.write_report(spark, {"seeds": [{"seed": 7, "f1_at_shared": 0.7}]}, str(tmp_path / "in" / "report"))
    cert = spark.createDataFrame([("safest", 3, 1.0, 1.0, 2.0), ("balanced", 1, 0.0, 1.0, None)], "mode string, routes long, proven_rate double, feasible_rate double, mean_gap_pct double")
    cert.write.parquet(str(tmp_path / "cert"))
    out = str(tmp_path / "out")
    assert main(["final-evaluation", str(tmp_path / "in"), out, "--certification", str(tmp_path / "cert")]) == 0
    report, told = files.read_report(spark, f"{out}/report"), files.read_report(spark, f"{out}/manifest")
    assert report["safety_gate_counts"]["good"] == 2 and set(report["bootstrap_95_percent_intervals"]) == {"roc_auc", "average_precision", "f1", "precision", "recall"}
    assert told["files"]["gates"] == "gates" and told["key_metrics"]["rcsp_certification_rate"] == 0.75 and told["key_metrics"]["mean_gap_pct"] == 2.0
    assert json.dumps(report).count(str(tmp_path)) == 0
    part = next((tmp_path / "out" / "districts").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿district,".encode())
    assert files.read_csv(spark, f"{out}/districts").columns[0] == "district"
    assert "## Gates" in "\n".join(r["value"] for r in spark.read.text(f"{out}/text").collect())


def test_endpoints(spark):
    s = spark.createDataFrame([("A", "2 Road", 36.1, 127.1), ("A", "1 Road", 36.2, 127.2), ("B", "3 Road", 36.3, 127.3)], "name string, address string, lat double, lon double")
    cells = spark.createDataFrame([("f", "s", 1, ["학원명", "학원주소"]), ("f", "s", 2, ["X", "9 Street"]), ("f", "s", 3, ["Y", None]), ("f", "t", 1, ["other"])], "file string, sheet string, row long, cells array<string>")
    cache = spark.createDataFrame([("9 Street", 36.9, 127.9)], "address string, lat double, lon double")
    got = schools.route_endpoints(s, workbook.places(cells), "A", "X", cache).first()
    assert (got["origin_address"], got["origin_lat"], got["destination_address"], got["destination_lat"]) == ("1 Road", 36.2, "9 Street", 36.9)
    got = schools.route_endpoints(s, workbook.places(cells), "B", "Y", cache, lambda a: None, (1.0, 2.0), "9 Street, Town").first()
    assert (got["destination_lat"], got["destination_lon"], got["destination_geocode_query"], got["destination_address"]) == (1.0, 2.0, "9 Street, Town", None)
    assert schools.route_endpoints(s, workbook.places(cells), "Z", "X", cache).count() == 0


def test_collect(spark, tmp_path):
    calls, broken = [], []

    def job(n):
        def get():
            calls.append(n)
            if broken:
                raise OSError("no answer")
            return spark.range(n)

        return get

    jobs = {"bumps": job(3), "zones": job(5)}
    assert remote.collect(spark, jobs, str(tmp_path)) == ({"bumps": 3, "zones": 5}, {})
    assert remote.collect(spark, jobs, str(tmp_path)) == ({"bumps": 3, "zones": 5}, {}) and calls == [3, 5]
    assert remote.collect(spark, jobs | {"bumps": job(4)}, str(tmp_path), refresh=True)[0] == {"bumps": 4, "zones": 5}
    broken.append(1)
    counts, bad = remote.collect(spark, jobs | {"stops": job(1)}, str(tmp_path), refresh=True)
    assert counts == {"bumps": 4, "zones": 5, "stops": 0} and set(bad) == {"bumps", "zones", "stops"}


@pytest.mark.parametrize("size", [1, 3, 6])
def test_demo_features(spark, size):
    nodes, edges = remote.demo_graph(spark, size)
    assert nodes.count() == size * size and edges.count() == 4 * size * (size - 1)
    assert {*remote.DEMO_FEATURES, *remote.DEMO_SAFE, "cmcs", "length_m"} <= set(edges.columns)
    for r in edges.collect():
        row = [int(x[1:].split("_")[0]) for x in (r["u"], r["v"])]
        assert (r["accident_count_norm"] == 0.9) == (row == [2, 2]) and r["is_school_zone"] == int(sum(row) / 2 <= 1.25) and r["length"] == (90.0 if row[0] == row[1] else 110.0)
    if size > 2:
        assert edges.where("accident_count_norm = 0.9").agg({"cmcs": "min"}).first()[0] > edges.where("accident_count_norm < 0.9").agg({"cmcs": "max"}).first()[0] + 0.2


def test_rows_counted_once_give_what_all_rows_give(spark, same):
    from pathwarden.operators import evaluation, metrics, ordering

    rows = [(f"D{i % 3}", None if i % 11 == 0 else int(i * 7 % 5 > 2), None if i % 13 == 0 else (i % 9) / 8.0) for i in range(400)]
    df = spark.createDataFrame(rows, "district string, accident_label int, oof_risk_probability double")
    few = evaluation.alike(df)
    assert few.count() < 80 and few.agg({"n": "sum"}).first()[0] == 400
    a, b = evaluation.judged(df), evaluation.judged(few, n="n")
    same(evaluation.overall(a).toPandas(), evaluation.overall(b, "n").toPandas())
    same(evaluation.by_district(a).toPandas(), evaluation.by_district(b, n="n").toPandas())
    same(metrics.regional_metrics(a, "y", "p", ["district"]).toPandas(), metrics.regional_metrics(b, "y", "p", ["district"], "n").toPandas())
    ps = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    want = ordering.quantiles(df, {"p": (df["oof_risk_probability"], ps)})["p"]
    assert ordering.counted_quantiles(few, "oof_risk_probability", "n", ps) == pytest.approx(want, abs=1e-12)
    assert ordering.counted_quantiles(few.limit(0), "oof_risk_probability", "n", ps) is None


def test_whole_numbers_are_those_of_round(spark):
    from pyspark.sql import functions as F

    from pathwarden.adapters import whole

    rows = [(x,) for x in (0.0, 0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, 2.4999999999999996, -2.4999999999999996, 0.07 * 100, 0.29 * 100, 1e15 + 0.5, 1e300, None)]
    got = spark.createDataFrame(rows, "x double").select(whole(F.col("x")).alias("a"), F.round("x").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
