"""Routes between many pairs: comparison, trade-offs and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.operators.ants import Colony, hybrid
from pathwarden.operators.graph import Local, solve

#: A graph beyond so many edges isn't broadcast; use graph.bounded_path for it.
MOST_EDGES = 5_000_000
_ROUTE = "origin string, destination string, mode string, lam double, limit double, path array<string>, edge_path array<string>, objective double, distance double, exposure double, proven boolean, source string, gap_pct double"


def local_rows(edges: DataFrame) -> list[tuple]:
    """The edges (u, v, edge_id, length, cmcs, safety_cost) of a graph that is small enough, in order of edge_id."""
    slim = edges.select(F.col("u").cast("string"), F.col("v").cast("string"), F.col("edge_id").cast("string"), "length", "cmcs", "safety_cost")
    rows = slim.orderBy("edge_id", "u", "v").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; use graph.bounded_path")
    return [tuple(r) for r in rows]


def route_many(edges: DataFrame, requests: DataFrame, ants: bool = False, colony: Colony = Colony(), budget: float | None = None, shared: Broadcast | None = None) -> DataFrame:  # noqa: B008
    """A row per request (origin, destination, mode, lam, limit) that has a route.

    Modes are shortest, safest and balanced.  Requests are dealt to all executors; unknown nodes and
    requests without a path give no row.  ``shared`` holds :func:`local_rows` of ``edges`` where several calls share them.
    """
    shared = shared or edges.sparkSession.sparkContext.broadcast(local_rows(edges))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Local.of(shared.value)
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if not (g.has(r.origin) and g.has(r.destination)):
                    continue
                limit = None if pd.isna(r.limit) else float(r.limit)
                lam = 0.5 if pd.isna(r.lam) else float(r.lam)
                if ants:
                    h = hybrid(g, r.origin, r.destination, r.mode, limit, lam, colony, budget)
                    found, source, proven = h.found, h.source, h.proven
                    gap = None if not (h.ants.best and h.exact_objective) else (h.ants.best.objective - h.exact_objective) / h.exact_objective * 100
                else:
                    found, source, proven, gap = solve(g, r.origin, r.destination, r.mode, limit, lam), "rcsp", True, None
                if found:
                    rows.append((r.origin, r.destination, r.mode, lam, limit, found.path, found.edges, found.objective, found.distance, found.exposure, proven, source, gap))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _ROUTE.split(", ")]).astype({"lam": float, "limit": float, "gap_pct": float})

    slim = requests.select(F.col("origin").cast("string"), F.col("destination").cast("string"), "mode", F.col("lam").cast("double"), F.col("limit").cast("double"))
    return slim.repartition("origin", "destination").mapInPandas(run, _ROUTE)


def search_history(edges: DataFrame, requests: DataFrame, colony: Colony = Colony()) -> DataFrame:  # noqa: B008
    """A row per request and iteration of its colony: what its ants found, the best so far, and how the exact search ended.

    Histories leave their task as arrays of structs and are exploded here.  Unknown nodes give no row.
    """
    shared = edges.sparkSession.sparkContext.broadcast(local_rows(edges))
    step = "struct<iteration:int,iteration_best:double,best_objective:double,feasible_ants:int,success_rate:double,mean_objective:double,std_objective:double>"
    keys = "origin string, destination string, mode string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Local.of(shared.value)
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if not (g.has(r.origin) and g.has(r.destination)):
                    continue
                h = hybrid(g, r.origin, r.destination, r.mode, None if pd.isna(r.limit) else float(r.limit), 0.5 if pd.isna(r.lam) else float(r.lam), colony)
                rows.append((r.origin, r.destination, r.mode, h.ants.history, h.exact_objective, h.proven))
            yield pd.DataFrame(rows, columns=["origin", "destination", "mode", "history", "exact_objective", "proven"]).astype({"exact_objective": float})

    slim = requests.select(F.col("origin").cast("string"), F.col("destination").cast("string"), "mode", F.col("lam").cast("double"), F.col("limit").cast("double"))
    got = slim.repartition("origin", "destination").mapInPandas(run, f"{keys}, history array<{step}>, exact_objective double, proven boolean")
    return got.select("origin", "destination", "mode", "exact_objective", "proven", F.explode("history").alias("h")).select("origin", "destination", "mode", "h.*", "exact_objective", "proven")


def certification(history: DataFrame) -> DataFrame:
    """(mode, routes, proven_rate, feasible_rate, mean_gap_pct) of a :func:`search_history`: a gap is the colony's last best above the exact optimum."""
    last = history.groupBy("origin", "destination", "mode").agg(F.max_by("best_objective", "iteration").alias("best"), F.max("exact_objective").alias("exact"), F.bool_or("proven").alias("proven"))
    gap = F.try_divide((F.col("best") - F.col("exact")) * 100, F.col("exact"))
    return last.groupBy("mode").agg(F.count(F.lit(1)).alias("routes"), F.avg(F.col("proven").cast("double")).alias("proven_rate"), F.avg(F.col("best").isNotNull().cast("double")).alias("feasible_rate"), F.avg(gap).alias("mean_gap_pct"))


def requests(pairs: DataFrame, modes: list[tuple[str, float | None]], limits: DataFrame | None = None) -> DataFrame:
    """``pairs`` (origin, destination) for each mode; ``limits`` has (origin, destination, limit)."""
    m = F.explode(F.array(*[F.struct(F.lit(a).alias("mode"), F.lit(b).cast("double").alias("lam")) for a, b in modes])).alias("m")
    out = pairs.select("origin", "destination", m).select("origin", "destination", "m.mode", "m.lam")
    if limits is None:
        return out.withColumn("limit", F.lit(None).cast("double"))
    return out.join(limits, ["origin", "destination"])


def compare(edges: DataFrame, pairs: DataFrame, max_detour: float | None = None, lam: float = 0.5, ants: bool = False, colony: Colony = Colony()) -> DataFrame:  # noqa: B008
    """Shortest, safest and balanced routes of each pair beside the shortest."""
    shared = edges.sparkSession.sparkContext.broadcast(local_rows(edges))
    base = route_many(edges, requests(pairs.distinct(), [("shortest", None)]), ants, colony, shared=shared)
    base = base.persist()
    limit = F.lit(None).cast("double") if max_detour is None else F.bround("distance", 2) * max_detour
    others = route_many(edges, requests(base.select("origin", "destination"), [("safest", None), ("balanced", lam)], base.select("origin", "destination", limit.alias("limit"))), ants, colony, shared=shared)
    b = base.select("origin", "destination", F.bround("distance", 2).alias("_d"), F.bround("exposure", 4).alias("_x"))
    out = base.unionByName(others).withColumns({"distance": F.bround("distance", 2), "exposure": F.bround("exposure", 4)}).join(b, ["origin", "destination"])
    return out.withColumns({
        "extra_distance": F.bround(F.col("distance") - F.col("_d"), 2),
        "reduction_pct": F.when(F.col("_x") > 0, F.bround((F.col("_x") - F.col("exposure")) / F.col("_x") * 100, 2)).otherwise(0.0),
        "detour_ratio": F.coalesce(F.bround(F.try_divide("distance", "_d"), 6), F.lit(0.0)), "segments": F.size("edge_path"),
    }).drop("_d", "_x")


def pareto_front(edges: DataFrame, pairs: DataFrame, steps: int = 11, limit: float | None = None) -> DataFrame:
    """Balanced routes over evenly spaced lam; of equal (distance, exposure) the smallest lam."""
    if steps < 2:
        raise ValueError("steps must be at least 2")
    lams = [("balanced", i / (steps - 1)) for i in range(steps)]
    req = requests(pairs, lams).withColumn("limit", F.lit(limit).cast("double"))
    r = route_many(edges, req).withColumns({"distance": F.bround("distance", 2), "exposure": F.bround("exposure", 4)})
    first = Window.partitionBy("origin", "destination", "distance", "exposure").orderBy("lam")
    return r.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def avoided(compared: DataFrame) -> DataFrame:
    """(edge_id, pairs): on how many pairs an edge of the shortest route isn't on the safest."""
    steps = compared.select("origin", "destination", "mode", F.explode("edge_path").alias("edge_id")).distinct()
    keys = ["origin", "destination", "edge_id"]
    gone = steps.where("mode = 'shortest'").select(*keys).join(steps.where("mode = 'safest'").select(*keys), keys, "left_anti")
    return gone.groupBy("edge_id").agg(F.count("*").alias("pairs"))


def od_report(compared: DataFrame, total: int, max_detour: float) -> DataFrame:
    """One row on a batch of pairs: evaluated, skipped, detours, reductions and the stability gate."""
    w = compared.groupBy("origin", "destination").agg(*[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for m in ("shortest", "safest") for c in ("distance", "exposure")], F.bool_and("proven").alias("proven"))
    ratio = F.coalesce(F.try_divide("safest_distance", "shortest_distance"), F.lit(0.0))
    cut = F.when(F.col("shortest_exposure") > 0, F.bround((F.col("shortest_exposure") - F.col("safest_exposure")) / F.col("shortest_exposure") * 100, 2)).otherwise(0.0)
    w = w.where("safest_distance is not null").withColumns({"_r": ratio, "_c": cut})
    out = w.agg(
        F.count("*").alias("evaluated"), (F.lit(total) - F.count("*")).alias("skipped"), F.count_if(F.col("_r") > max_detour).alias("exceeded"), F.bround(F.avg(F.bround("_r", 4)), 4).alias("mean_detour"),
        F.bround(F.avg("_c"), 2).alias("mean_reduction"), F.median("_c").alias("median_reduction"), F.percentile("_r", 0.95).alias("p95_detour"), F.avg((F.col("_c") > 0).cast("double")).alias("positive_share"), F.bool_and("proven").alias("all_proven"),
    )
    return out.withColumn("stable", (F.col("evaluated") >= 6) & (F.col("positive_share") >= 0.8) & (F.col("median_reduction") > 0) & (F.col("exceeded") == 0))


def route_edges(edges: DataFrame, path: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The ``edges`` (u, v, key, edge_id) that a route's ``path`` (u, v, key) takes in either direction, compared as text.

    Where none is found, those whose edge_id is in ``ids`` (edge_id).
    """
    text = lambda d, *cs: d.select(*[F.col(c).cast("string").alias(n) for n, c in zip(("_u", "_v", "_k"), cs)])
    taken = text(path, "u", "v", "key").unionByName(text(path, "v", "u", "key")).distinct()
    same = [edges[c].cast("string").eqNullSafe(taken[n]) for c, n in (("u", "_u"), ("v", "_v"), ("key", "_k"))]
    out = edges.join(taken, same[0] & same[1] & same[2], "left_semi")
    if ids is None or "edge_id" not in edges.columns or out.limit(1).count():
        return out
    named = ids.select(F.col("edge_id").cast("string").alias("_id")).distinct()
    return edges.join(named, edges["edge_id"].cast("string") == named["_id"], "left_semi")
