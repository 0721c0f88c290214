"""Regressions of all folds against plain Newton fits, fold by fold; the evidence made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwarden.operators import evidence, glm, models


def _rows(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 40, 0.01] + [0, 500, 7]
    z = x[:, 0] + (x[:, 1] - 500) / 40
    y = (z + rng.logistic(size=n) > 0.8).astype(int)
    rate, w = rng.poisson(np.exp(0.4 * x[:, 0] - 0.5)) / 1.0, rng.uniform(0.05, 3, n)
    rows = [(int(i), None if i % 5 == 4 else f"D{i % 5}", float(a[0]), None if i % 17 == 0 else float(a[1]), float("nan") if i % 23 == 0 else float(a[2]), int(y[i]), float(rate[i]), float(w[i])) for i, a in enumerate(x)]
    return rows, spark.createDataFrame(rows, "id int, g string, a double, b double, c double, y int, rate double, w double")


def _plain(rows, out, family, penalty, weights=None):
    """One fold's model by undamped Newton steps on lists."""
    rest = [r for r in rows if r[1] != out]
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rest])
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), med, x)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    y = np.array([r[5] if family == "logistic" else r[6] for r in rest], float)
    if family == "logistic":
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    else:
        w = np.array([r[7] for r in rest])
    beta, lam = np.zeros(4), penalty(len(rest)) * np.array([0, 1, 1, 1])
    for _ in range(200):
        eta = z @ beta
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        bend = mu if family == "poisson" else mu * (1 - mu)
        step = np.linalg.solve((z.T * (w * bend)) @ z / w.sum() + np.diag(lam), z.T @ (w * (mu - y)) / w.sum() + lam * beta)
        beta = beta - np.clip(step, -1, 1)
    return beta, med, x.mean(0), x.std(0)


@pytest.mark.parametrize("family", ["poisson", "logistic"])
def test_every_fold_equals_a_plain_fit(spark, family):
    rows, df = _rows(spark)
    penalty = (lambda n: 1.0) if family == "poisson" else (lambda n: 2.0 / n)
    how = {"weight": "w"} if family == "poisson" else {"balanced": True}
    y = "rate" if family == "poisson" else "y"
    got = glm.fit(df.repartition(3), ["a", "b", "c"], y, "g", family, penalty, **how)
    assert [m.fold for m in got] == [None, "D0", "D1", "D2", "D3"]
    predicted = {r["id"]: r["p"] for r in glm.held_out(df, ["a", "b", "c"], "g", got, family).collect()}
    for m in got:
        beta, med, mean, std = _plain(rows, m.fold, family, penalty)
        assert np.allclose([m.intercept, *m.coefficients], beta, atol=1e-7)
        for r in rows:
            if r[1] == m.fold:
                x = np.array([q if v is None or v != v else v for v, q in zip(r[2:5], med)])
                eta = beta[0] + beta[1:] @ ((x - mean) / std)
                assert abs(predicted[r[0]] - (np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta)))) < 1e-6


def test_folds_without_events_or_features(spark):
    d = "g string, a double, y int"
    one = spark.createDataFrame([("p", 1.0, 1), ("p", 2.0, 0), ("q", 1.0, 0), ("q", None, 0)], d)
    got = glm.fit(one, ["a"], "y", "g", "logistic", lambda n: 1.0, balanced=True)
    # Without p no row is positive.
    assert [m.fold for m in got] == ["q"]
    p = {(r["g"], r["a"]): r["p"] for r in models.logistic_out_of_fold(one.withColumn("_y", F.col("y").cast("double")), ["a"], "g").collect()}
    assert p["p", 1.0] == p["p", 2.0] == 0.0 and 0 < p["q", None] < 1
    flat = spark.createDataFrame([("p", None, 1), ("p", None, 0), ("q", None, 1), ("q", None, 0)], d)
    assert [float(m.coefficients[0]) for m in glm.fit(flat, ["a"], "y", "g", "logistic", lambda n: 1.0)] == [0.0, 0.0]
    assert glm.fit(one.limit(0), ["a"], "y", "g", "poisson", lambda n: 1.0) == []
    with pytest.raises(ValueError):
        glm.fit(one, ["a"], "y", "g", "probit", lambda n: 1.0)


def _cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        f = rng.uniform(size=len(evidence.FEATURES))
        count = int(rng.poisson(np.exp(2 * f[0] - f[13] - 0.5)))
        rows.append((f"c{i}", f"D{i % 5}", float(i % 20 * 500), float(i // 20 * 500), float(rng.uniform(10, 2000)), count, int(count > 0), *map(float, f)))
    names = ["cell", "district", "center_x", "center_y", "length_m", "accident_count", "accident_label", *evidence.FEATURES]
    return rows, spark.createDataFrame(rows, names)


def test_evidence_of_regressions(spark):
    rows, cells = _cells(spark)
    signs = {f: s for f, _, s in evidence.SPECS}
    got = {r["feature"]: r for r in models.logistic_evidence(cells, evidence.FEATURES, "accident_label", "district").collect()}
    fits, auc_pairs = [], []
    for out in sorted({r[1] for r in rows}):
        rest, held = [r for r in rows if r[1] != out], [r for r in rows if r[1] == out]
        x, y = np.array([r[7:] for r in rest]), np.array([r[6] for r in rest], float)
        mean, std = x.mean(0), x.std(0)
        z = np.column_stack([np.ones(len(x)), (x - mean) / std])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        beta, lam = np.zeros(z.shape[1]), 2 / len(y) * np.array([0, *[1] * (z.shape[1] - 1)])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve((z.T * (w * mu * (1 - mu))) @ z / len(y) + np.diag(lam), z.T @ (w * (mu - y)) / len(y) + lam * beta)
        fits.append(beta[1:])
        auc_pairs += [(beta[0] + beta[1:] @ ((np.array(r[7:]) - mean) / std), r[6]) for r in held]
    pos, neg = [p for p, y in auc_pairs if y], [p for p, y in auc_pairs if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    for i, f in enumerate(evidence.FEATURES):
        effects = np.array([b[i] for b in fits]) * signs[f]
        assert abs(got[f]["signed_effect"] - np.median(effects)) < 1e-6 and got[f]["consistency"] == np.mean(effects > 0)
        assert abs(got[f]["score"] - max(0, np.median(effects)) * np.mean(effects > 0) * max(0, (auc - 0.5) / 0.5)) < 1e-6
    counted = {r["feature"]: r for r in models.poisson_evidence(cells, evidence.FEATURES, "accident_count", "district").collect()}
    assert counted[evidence.FEATURES[0]]["consistency"] == 1.0 and counted[evidence.FEATURES[0]]["score"] >= 0


def test_weights_from_all_channels(spark):
    _, cells = _cells(spark)
    weights, channels = evidence.derive_weights(cells, permutations=19)
    assert channels.count() == 4 * len(evidence.FEATURES) and weights.source == "data_driven"
    assert abs(sum(weights.dimensions.values()) - 1) < 1e-9 and sum(weights.safety_bonus.values()) <= evidence.BONUS_CAP + 1e-9
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in weights.sub_weights.values())
    # The planted cause weighs most in its dimension.
    assert weights.sub_weights["risk"]["traffic_volume_norm"] > weights.sub_weights["risk"]["avg_speed_norm"]
