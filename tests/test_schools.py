"""Schools, accident places, the score's inputs, route edges and fitted weights on small rows."""

import numpy as np
import pytest

from pathwarden.operators import models, routes, schools, segments


def test_schools_without_neighbours(spark):
    s = spark.createDataFrame([(1, 36.3, 127.3, "D1"), (2, 36.9, 127.9, None), (3, None, 127.0, "D1")], "school_id int, lat double, lon double, district string")
    c = spark.createDataFrame([(7, 36.3, 127.3, "y", "2"), (8, 36.3005, 127.3, None, "x"), (9, None, 127.3, "Y", "4")], "crosswalk_id int, lat double, lon double, flag string, lanes string")
    none = spark.createDataFrame([], "signal_id int, lat double, lon double, flag string")
    h = spark.createDataFrame([(5, 36.302, 127.3, 2020, "a"), (4, 36.302, 127.3, 2019, "b")], "spot_id int, lat double, lon double, search_year int, spot_nm string")
    got = schools.risk_dataset(s, c, none, h, crosswalk_flags={"flag": "share"}, signal_flags={}, lanes={"lanes": "mean"}).toPandas().set_index("school_id")
    assert sorted(got.index) == [1, 2]
    one, two = got.loc[1], got.loc[2]
    assert (one["crosswalk_count_100m"], one["share"], one["mean"], one["nearest_crosswalk_m"]) == (2, 0.5, 2.0, 0.0)
    assert (one["accident_hotspot_within_radius"], one["nearest_hotspot_year"], one["nearest_hotspot_name"]) == (1, 2019, "b")
    assert (two["crosswalk_count_500m"], two["share"], two["mean"], two["accident_hotspot_within_radius"]) == (0, 0.0, 0.0, 0) and two["nearest_crosswalk_m"] > 60_000
    assert got["nearest_signal_m"].isna().all()


def test_operating_drops_nulls(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), (None, 1.0), ("B", 1.0)], "kind string, lat double")
    assert schools.operating(df, {"kind": "A"}, ("lat",)).count() == 1


def test_inputs_of_nulls_and_constants(spark):
    names = ["traffic_volume_proxy", "avg_speed_kph", "narrow_sidewalk_proxy", "slope_proxy", "lane_count", "lit_tag_score", "is_school_zone", "school_zone_cctv_count", *[c for c in segments.SCALED]]
    rows = [tuple(None for _ in names), tuple(3.0 for _ in names)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    empty, full = sorted(segments.normalised(df).collect(), key=lambda r: r["avg_speed_kph"] or 0)
    assert empty["traffic_volume_norm"] is None and empty["light_density_norm"] is None and empty["accident_count_norm"] == 0.0 and empty["has_cctv"] == 0
    assert full["traffic_volume_norm"] == 1.0 and full["avg_speed_norm"] == 0.03 and full["lane_count_norm"] == 0.5 and full["accident_count_norm"] == 1.0 and full["pedestrian_flow_norm"] == 1.0
    assert segments.normalised(df.limit(0)).count() == 0


def test_route_edges_by_id_where_no_key_fits(spark):
    e = spark.createDataFrame([(1, 2, None, "a"), (2, 3, 0, "b"), (3, 2, 1, "c")], "u int, v int, key int, edge_id string")
    path = spark.createDataFrame([("2", "1", None), ("3", "2", "0")], "u string, v string, key string")
    assert sorted(r["edge_id"] for r in routes.route_edges(e, path).collect()) == ["a", "b"]
    ids = spark.createDataFrame([("c",), ("d",)], "edge_id string")
    assert [r["edge_id"] for r in routes.route_edges(e, path.limit(0), ids).collect()] == ["c"]


def test_fitted_weights_are_the_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 2)).round(3)
    y = (x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.5, 400) > 1.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, hits int")
    w = models.fit_weights(df, "hits", ["a", "b", "a", "absent"])
    assert list(w) == ["a", "b", "absent"] and abs(w["absent"]) < 1e-9
    weight = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    b, z = np.array([w["a"], w["b"]]), x @ np.array([w["a"], w["b"]])
    lo, hi = -50.0, 50.0
    for _ in range(100):  # the best intercept, by bisection
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (weight * (1 / (1 + np.exp(-z - mid)) - y)).sum() > 0 else (mid, hi)
    gradient = x.T @ (weight * (1 / (1 + np.exp(-z - lo)) - y)) + b
    assert np.abs(gradient).max() < 1e-2
    with pytest.raises(ValueError):
        models.fit_weights(df.where("hits = 0"), "hits", ["a"])
