import pytest

from pathwarden.__main__ import main
from pathwarden.api import Engine, Invalid, RouteRequest, TTLCache
from pathwarden.sources.remote import demo_graph


@pytest.fixture(scope="module")
def engine(spark):
    nodes, edges = demo_graph(spark)
    places = spark.createDataFrame([("School (A)", "1 Road", "D1", 36.35, 127.38), ("Academy", "2 School Road", "D2", 36.35, 127.38)], "name string, address string, district string, lat double, lon double")
    return Engine(nodes, edges, places)


def test_recommend(engine):
    r = engine.recommend(RouteRequest((36.352, 127.380), (36.352, 127.384), "safest"))
    assert r["path"][0] == "N2_0" and r["path"][-1] == "N2_4"
    assert engine.recommend(RouteRequest((36.352, 127.380), (36.352, 127.384), "safest")) == r and engine.routes.hits == 1
    assert {x["mode"] for x in engine.compare((36.352, 127.380), (36.352, 127.384))} == {"shortest", "safest", "balanced"}
    assert engine.health()["ready"]


def test_many(spark, engine):
    df = spark.createDataFrame([("N0_0", "N4_4", "balanced", "low"), ("N0_0", "N4_4", "shortest", "mid"), ("N0_0", "zz", "safest", "mid")], "origin string, destination string, mode string, age_group string")
    assert engine.recommend_many(df).count() == 2


@pytest.mark.parametrize("bad", [{"origin": (99, 0)}, {"hour": 25}, {"mode": "x"}, {"age_group": "x"}, {"lam": 2}])
def test_invalid(bad):
    with pytest.raises(Invalid):
        RouteRequest(**({"origin": (36.0, 127.0), "destination": (36.0, 127.0)} | bad))


def test_search_is_literal(engine):
    assert [r["name"] for r in engine.search("school (")] == ["School (A)"] and len(engine.search("school")) == 2
    assert engine.search("school", "D2")[0]["name"] == "Academy" and engine.search(".*") == []


def test_cache():
    now = [0.0]
    c = TTLCache(10, 2, lambda: now[0])
    for k in "abc":
        now[0] += 1
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    now[0] = 20
    assert c.get("c") is None


def test_commands(capsys):
    assert main(["demo"]) == 0
    assert "shortest: 360.0 m" in capsys.readouterr().out
