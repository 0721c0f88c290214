import random

import pytest
from pyspark.sql import functions as F

from pathwarden.operators import graph as G
from pathwarden.operators import routes as R
from pathwarden.operators.ants import Colony, hybrid
from pathwarden.sources.remote import demo_graph

_EDGES = [("A", "B", "ab", 10.0, 10.0), ("B", "D", "bd", 10.0, 10.0), ("A", "C", "ac", 12.0, 3.0), ("A", "C", "ac2", 15.0, 30.0), ("C", "D", "cd", 12.0, 3.0), ("B", "C", "bc", 1.0, 50.0)]


def _brute(edges, a, b, limit):
    best = None

    def go(node, seen, obj, dist):
        nonlocal best
        if dist > limit:
            return
        if node == b:
            best = obj if best is None else min(best, obj)
            return
        for u, v, _, length, cost in edges:
            if u == node and v not in seen:
                go(v, seen | {v}, obj + cost, dist + length)

    go(a, {a}, 0.0, 0.0)
    return best


def _local(edges):
    """A local graph whose safety cost is the given cost."""
    return G.Local.of([(u, v, e, length, 0.0, cost) for u, v, e, length, cost in edges])


def test_known_optimum(spark):
    df = spark.createDataFrame(_EDGES, "u string, v string, edge_id string, length double, cost double")
    r = G.bounded_path(df, "A", "D", "cost", 30.0).first()
    assert (r["path"], r["objective"], r["resource"]) == (["A", "C", "D"], 6.0, 24.0)
    f = G.solve(_local(_EDGES), "A", "D", "safest", 30.0)
    assert (f.path, f.objective, f.distance, f.proven) == (["A", "C", "D"], 6.0, 24.0, True)


@pytest.mark.parametrize("seed", range(40))
def test_against_all_paths(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 7)
    edges = [(u, v, f"{u}{v}{k}", float(rng.randint(1, 9)), float(rng.randint(0, 9))) for u in range(n) for v in range(n) if u != v for k in range(rng.randint(0, 1) + (rng.random() < 0.2))]
    limit = rng.randint(3, 25)
    g = _local(edges)
    if not (g.has(0) and g.has(n - 1)):
        return
    f = G.solve(g, 0, n - 1, "safest", limit)
    want = _brute(edges, 0, n - 1, limit)
    assert (f and f.objective) == want
    h = hybrid(g, 0, n - 1, "safest", limit, c=Colony(ants=4, iterations=3))
    assert (h.found and h.found.objective) == want


def test_frontier_against_local(spark):
    rng = random.Random(5)
    edges = [(u, v, f"{u}-{v}", float(rng.randint(1, 9)), float(rng.randint(0, 9))) for u in range(6) for v in range(6) if u != v and rng.random() < 0.5]
    df = spark.createDataFrame(edges, "u int, v int, edge_id string, length double, cost double")
    for limit in (None, 12.0):
        r = G.bounded_path(df, 0, 5, "cost", limit).first()
        assert (r and r["objective"]) == _brute(edges, 0, 5, limit or 1e9)


def test_no_time_is_an_approximation():
    h = hybrid(_local(_EDGES), "A", "D", "safest", 30.0, budget=0.0)
    assert h.source == "aco_approx" and not h.proven and h.found.distance <= 30


def test_unknown_nodes_and_same_node():
    with pytest.raises(KeyError):
        hybrid(_local(_EDGES), "A", "Z", "safest")
    assert hybrid(_local(_EDGES), "A", "A", "safest").found.distance == 0


def test_parallel_edges_and_modes(spark):
    e = G.edge_costs(spark.createDataFrame([("A", "B", "short", 10.0, 0.9), ("A", "B", "long", 15.0, 0.1)], "u string, v string, edge_id string, length double, cmcs double"))
    assert G.cheapest_parallel(e, "length").first()["edge_id"] == "short" and G.cheapest_parallel(e, "safety_cost").first()["edge_id"] == "long"
    with pytest.raises(ValueError):
        G.balanced_cost(1.5)


def test_demo_is_safer(spark):
    _, edges = demo_graph(spark)
    pairs = spark.createDataFrame([("N2_0", "N2_4"), ("N0_0", "nowhere")], "origin string, destination string")
    got = {r["mode"]: r for r in R.compare(G.edge_costs(edges), pairs).collect()}
    assert set(got) == {"shortest", "safest", "balanced"}
    assert got["safest"]["exposure"] < got["shortest"]["exposure"] and got["shortest"]["distance"] == 360.0
    report = R.od_report(R.compare(G.edge_costs(edges), pairs, 2.0), 2, 2.0).first()
    assert (report["evaluated"], report["skipped"]) == (1, 1)


def test_skyline(spark):
    df = spark.createDataFrame([("n", 1.0, 5.0, "a"), ("n", 2.0, 4.0, "b"), ("n", 3.0, 4.5, "c"), ("n", 2.0, 4.0, "d")], "node string, r double, o double, path string")
    assert sorted(r["path"] for r in G.skyline(df, "node", "r", "o").collect()) == ["a", "b"]
    assert G.edge_costs(spark.createDataFrame([("e", 1.0)], "edge_id string, length double")).select(F.round("safety_cost", 6)).first()[0] == 0.55


def test_history_of_a_search(spark):
    from pathwarden.operators import graph, routes
    from pathwarden.sources.remote import demo_graph

    edges = graph.edge_costs(demo_graph(spark)[1])
    pairs = spark.createDataFrame([("N0_0", "N4_4"), ("N2_0", "N2_4"), ("N0_0", "nowhere")], "origin string, destination string")
    history = routes.search_history(edges, routes.requests(pairs, [("safest", None), ("balanced", 0.5)]))
    rows = sorted(history.collect(), key=lambda r: (r["origin"], r["mode"], r["iteration"]))
    assert len(rows) == 2 * 2 * 40
    best = {}
    for r in rows:
        k = r["origin"], r["mode"]
        best[k] = min(best.get(k, float("inf")), r["iteration_best"])
        assert abs(r["best_objective"] - best[k]) < 1e-6 and r["proven"] and r["best_objective"] >= r["exact_objective"] - 1e-6
        assert r["feasible_ants"] == round(r["success_rate"] * 32) and r["mean_objective"] >= r["iteration_best"] - 1e-6
    got = {r["mode"]: r for r in routes.certification(history).collect()}
    assert got["safest"]["routes"] == 2 and got["balanced"]["proven_rate"] == 1.0 and got["safest"]["mean_gap_pct"] >= -1e-9
