"""Weights where every cell has the same target, as large tables have: no channel finds anything."""

import pytest

from pathwarden.operators import evidence
from pathwarden.plans import queries


def _cells(spark, accidents):
    rows = [(f"c{i}", f"D{i % 3}", *(float((i * (j + 3)) % (7 + j)) for j in range(len(evidence.FEATURES))), float(i % 10), float(i // 10), 500.0, accidents(i), int(accidents(i) > 0)) for i in range(90)]
    names = ", ".join(f"{f} double" for f in evidence.FEATURES)
    return spark.createDataFrame(rows, f"cell string, district string, {names}, center_x double, center_y double, length_m double, accident_count double, accident_label int")


def test_query_gives_null_weights_without_evidence(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "_evidence_cells", lambda *_: _cells(spark, lambda i: 2.0))
    got = queries.QUERIES["derived_weights"](spark, sf).toPandas()
    assert sorted(got["feature"]) == sorted(evidence.FEATURES)
    assert got["dimension_weight"].isna().all() and got["sub_weight"].isna().all()
    assert (got[["spearman", "poisson", "logistic", "moran"]] == 0).all().all()
    with pytest.raises(ValueError):
        evidence.weights_of(evidence.dimension_weights(evidence.combine(spark.createDataFrame([("moran", f, 0.0) for f in evidence.FEATURES], "channel string, feature string, score double"))))


def test_rows_are_the_weights_where_there_is_evidence(spark):
    rows = [(c, f, float((i * 7 + j * 5) % 11)) for j, c in enumerate(("spearman", "moran")) for i, f in enumerate(evidence.FEATURES)]
    channels = spark.createDataFrame(rows, "channel string, feature string, score double")
    w = evidence.weights_of(evidence.dimension_weights(evidence.combine(channels)))
    got = {r["feature"]: r for r in evidence.weight_rows(channels).collect()}
    assert len(got) == 16
    for d, f, x in w.rows():
        assert abs(got[f]["sub_weight"] - x) < 1e-12 and got[f]["dimension"] == d
        assert got[f]["dimension_weight"] is None if d == "safety_bonus" else abs(got[f]["dimension_weight"] - w.dimensions[d]) < 1e-12
