import pytest
from pyspark.sql import functions as F

import numpy as np

from pathwarden.functions import geo, roads
from pathwarden.operators import evidence as E
from pathwarden.operators import metrics as M
from pathwarden.operators import scoring as S


def test_safer_is_lower_and_bounded(spark):
    cols = ["accident_count_norm", "traffic_volume_norm", "avg_speed_norm", "narrow_sidewalk_norm", "slope_norm", "is_alley", "illegal_parking_norm", "light_density_norm", "has_crosswalk", "has_signal", "has_speed_bump", "has_cctv"]
    df = spark.createDataFrame([("risky", *[1.0] * 7, 0.0, 0.0, 0.0, 0.0, 0.0), ("safe", *[0.0] * 7, 1.0, 1.0, 1.0, 1.0, 1.0)], "id string, " + ", ".join(f"{c} double" for c in cols))
    r = {x["id"]: x["cmcs"] for x in S.score(df).collect()}
    assert 0 <= r["safe"] < r["risky"] <= 1


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        S.Weights(dimensions={"risk": 0.5, "discomfort": 0.5, "congestion": 0.5})
    assert S.Weights.from_json(S.Weights().to_json()) == S.Weights()


def test_thresholds_and_ties(spark):
    df = spark.createDataFrame([(0, 0.05), (0, 0.10), (0, 0.40), (1, 0.45), (1, 0.90)], "y int, p double")
    assert 0.40 < M.ranking_metrics(df, "y", "p").first()["f1_threshold"] <= 0.45
    df = spark.createDataFrame([(0, 0.05), (0, 0.10), (0, 0.60), (1, 0.55), (1, 0.70), (1, 0.90)], "y int, p double")
    r = M.edge_metrics(df, "y", "p").first()
    assert r["f1_best"] >= 0.75 and r["f1_threshold"] != 0.5
    models = spark.createDataFrame([("RandomForest", 0.1555, 0.68, 0.1, 0.2), ("Boosting", 0.1561, 0.66, 0.1, 0.2)], "model string, average_precision double, roc_auc double, brier double, f1 double")
    assert M.best_tree_model(models).first()["model"] == "RandomForest"


def test_one_class_has_no_ranking(spark):
    r = M.ranking_metrics(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double"), "y", "p").first()
    assert r["roc_auc"] is None and r["average_precision"] is None


def test_calibration(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)], "y int, p double")
    assert M.calibration_error(df, "y", "p", 2).first()["ece"] == 0.0


def test_student_tail():
    assert abs(E.t_two_sided(0.6319, 10) - 0.05) < 1e-3 and E.t_two_sided(0.0, 10) == 1.0 and E.t_two_sided(1.0, 10) == 0.0


def test_spearman_and_moran(spark):
    df = spark.createDataFrame([(i, i * 0.1) for i in range(8)], "accident_count int, traffic_volume_norm double")
    r = E.spearman_evidence(df, features=["traffic_volume_norm"]).first()
    assert r["rho"] > 0 and r["score"] > 0
    line = spark.createDataFrame([(i, float(i), 0.0, v) for i, v in enumerate([0.0, 0.1, 0.9, 1.0])], "cell int, center_x double, center_y double, v double")
    assert E.bivariate_moran(line, "cell", ["v"], "v", 1).first()["moran"] > 0


def test_combined_weights(spark):
    rows = [("a", f, 1.0 + i) for i, (f, _, _) in enumerate(E.SPECS)]
    w = E.weights_of(E.dimension_weights(E.combine(spark.createDataFrame(rows, "channel string, feature string, score double"))))
    assert abs(sum(w.dimensions.values()) - 1) < 1e-9 and sum(w.safety_bonus.values()) <= 0.15 + 1e-9


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(roads.parse_number(F.lit("50 mph"), 1.0)) == 50 and get(roads.parse_number(F.lit("['2', '3']"), 1.0)) == 2
    assert get(roads.highway_value(F.lit("['residential', 'service']"))) == "residential"
    assert get(roads.segment_id(F.lit(10), F.lit(20), F.lit(123))) == get(roads.segment_id(F.lit(20), F.lit(10), F.lit(123)))
    assert get(roads.extract_district(F.lit("대전 유성구 1"))) == "유성구" and get(roads.extract_district(F.lit("x"))) is None
    assert get(geo.haversine(F.lit(36.0), F.lit(127.0), F.lit(36.0), F.lit(127.0))) == 0
    assert 100 < get(geo.haversine(F.lit(36.0), F.lit(127.0), F.lit(36.001), F.lit(127.0))) < 120
    x, y = geo.to_grid(F.lit(38.0), F.lit(127.5))
    assert abs(get(x) - 1_000_000) < 1e-3 and abs(get(y) - 2_000_000) < 1e-3


def test_detour_is_strict(spark):
    df = spark.createDataFrame([(100.0, 200.0), (100.0, 201.0), (0.0, 100.0)], "s double, c double")
    ratio, over = roads.detour(df.s, df.c, F.lit(2.0))
    assert [tuple(r) for r in df.select(ratio, over).collect()] == [(2.0, False), (2.01, True), (0.0, False)]


def test_bootstrap_intervals_are_those_of_plain_resampling(spark):
    rng = np.random.default_rng(2)
    n = 400
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(0.35 * y + rng.normal(0.35, 0.2, n), 0, 1).round(2)  # with ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(3)
    got = {r["metric"]: (r["lower"], r["upper"]) for r in M.bootstrap(df, "y", "p", 0.5, 3000).collect()}
    rows = []
    for _ in range(3000):
        i = rng.integers(0, n, n)
        a, b = y[i], p[i]
        pos, neg = np.sort(b[a == 1]), np.sort(b[a == 0])
        auc = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg)
        at = np.unique(b)[::-1]
        tp, fp = len(pos) - np.searchsorted(pos, at), len(neg) - np.searchsorted(neg, at)
        ap = (np.diff(tp, prepend=0) * tp / (tp + fp)).sum() / len(pos)
        t, f = (pos >= 0.5).sum(), (neg >= 0.5).sum()
        rows.append((auc, ap, 2 * t / (t + f + len(pos)), t / max(t + f, 1), t / len(pos)))
    lower, upper = np.quantile(rows, [0.025, 0.975], 0)
    for k, name in enumerate(["roc_auc", "average_precision", "f1", "precision", "recall"]):
        wide = upper[k] - lower[k]
        assert abs(got[name][0] - lower[k]) < 0.08 * wide and abs(got[name][1] - upper[k]) < 0.08 * wide, (name, got[name], lower[k], upper[k])
    assert M.bootstrap(df, "y", "p", 0.5, 50).collect() == M.bootstrap(df, "y", "p", 0.5, 50).collect()
    none = M.bootstrap(df.where("y = 0"), "y", "p", 0.5, 20).collect()
    assert [r["lower"] for r in none] == [None] * 5
