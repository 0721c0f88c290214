"""Paths under a limit on directed graphs of edges (u, v, edge_id, length, cmcs).

Two ways to the same optimum: label correcting over frontier DataFrames, for a graph of any
size, and label setting in a worker with the graph as a broadcast, for many pairs on a graph that is checked to be small.
"""

from __future__ import annotations

import heapq
import time
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.storage import ready
from pathwarden.functions.semantics import bounded, number

RISK_FLOOR = 0.05
LEAST_LENGTH = 0.01
DEFAULT_CMCS = 0.5
EPS = 1e-9


def edge_costs(edges: DataFrame, scores: DataFrame | None = None, default: float = DEFAULT_CMCS, risk_floor: float = RISK_FLOOR) -> DataFrame:
    """``edges`` with cmcs of ``scores`` (edge_id, cmcs) where it has one, and the two costs."""
    own = F.col("cmcs") if "cmcs" in edges.columns else F.lit(None).cast("double")
    if scores is not None:
        if not {"edge_id", "cmcs"} <= set(scores.columns):
            raise ValueError("scores need edge_id and cmcs")
        edges = edges.join(scores.select("edge_id", F.col("cmcs").alias("_s")), "edge_id", "left")
        own = F.coalesce(F.col("_s"), own)
    length = F.greatest(F.coalesce(number(edges, "length"), F.lit(1.0)), F.lit(LEAST_LENGTH))
    out = edges.withColumns({"cmcs": bounded(F.coalesce(own, F.lit(default))), "length": length})
    out = out.withColumns({"risk_exposure": F.col("length") * F.col("cmcs"), "safety_cost": F.col("length") * (F.lit(risk_floor) + F.col("cmcs"))})
    return out.drop("_s")


def balanced_cost(lam: float | Column, risk_floor: float = RISK_FLOOR) -> Column:
    """Length weighted between distance (1) and safety (0)."""
    if isinstance(lam, (int, float)):
        if not 0 <= lam <= 1:
            raise ValueError("lam must be within 0 and 1")
        lam = F.lit(float(lam))
    return F.col("length") * (lam + (1 - lam) * (F.lit(risk_floor) + F.col("cmcs")))


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(back)


def cheapest_parallel(edges: DataFrame, cost: str) -> DataFrame:
    """For each (u, v) the edge of least cost; ties by edge_id."""
    return edges.groupBy("u", "v").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("u", "v")]), F.struct(cost, "edge_id")).alias("e")).select("u", "v", "e.*")


def distances(edges: DataFrame, source, cost: str, reverse: bool = False, rounds: int = 10_000) -> DataFrame:
    """(node, dist): least cost from ``source`` (to it, with ``reverse``); relaxation rounds over a frontier, cut by checkpoints."""
    spark = edges.sparkSession
    ready(spark)
    a, b = ("v", "u") if reverse else ("u", "v")
    hop = edges.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.min(cost).alias("w")).persist()
    dist = edges.select(F.lit(source).cast(edges.schema["u"].dataType).alias("node"), F.lit(0.0).alias("dist")).limit(1).checkpoint()
    frontier = dist
    for _ in range(rounds):
        step = frontier.join(hop, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        frontier = step.join(dist, "node", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist") - EPS)).select("node", F.col("new").alias("dist")).checkpoint()
        if frontier.limit(1).count() == 0:
            break
        dist = dist.unionByName(frontier).groupBy("node").agg(F.min("dist").alias("dist")).checkpoint()
    hop.unpersist()
    return dist


def skyline(labels: DataFrame, node: str, *costs: str) -> DataFrame:
    """Labels that no other at the node betters in both of two costs; of equal ones, the first by ``path``."""
    a, b = costs
    before = Window.partitionBy(node).orderBy(a, b, "path").rowsBetween(Window.unboundedPreceding, -1)
    return labels.withColumn("_m", F.min(b).over(before)).where(F.col("_m").isNull() | (F.col(b) < F.col("_m"))).drop("_m")


def bounded_path(edges: DataFrame, origin, destination, objective: str, limit: float | None, resource: str = "length", rounds: int = 10_000) -> DataFrame:
    """One row (path, edge_path, objective, resource) of least objective with resource <= limit; none if there is no such path.

    Frontier rounds: extend labels, drop what can't reach the destination within the limit or
    can't better the incumbent, keep each node's skyline.  Costs must not be negative.
    """
    spark = edges.sparkSession
    ready(spark)
    cap = float("inf") if limit is None else float(limit) + EPS
    e = edges.select("u", "v", "edge_id", F.round(F.col(objective), 9).alias("o"), F.round(F.col(resource), 9).alias("r"))
    if e.where("o < 0 or r < 0 or o is null or r is null").limit(1).count():
        raise ValueError("costs must be numbers and not negative")
    to_r = distances(e, destination, "r", reverse=True).withColumnRenamed("dist", "rest_r")
    to_o = distances(e, destination, "o", reverse=True).withColumnRenamed("dist", "rest_o")
    rest = to_r.join(to_o, "node").select(F.col("node").alias("v"), "rest_r", "rest_o")
    hop = e.join(rest, "v").persist()
    kind = edges.schema["u"].dataType
    start = edges.limit(1).select(F.lit(origin).cast(kind).alias("node"), F.lit(0.0).alias("o"), F.lit(0.0).alias("r"), F.array(F.lit(origin).cast(kind).cast("string")).alias("path"), F.array().cast("array<string>").alias("edge_path"))
    settled, frontier, best = start.checkpoint(), start, None
    for _ in range(rounds):
        f = frontier.alias("f").join(hop.alias("h"), F.col("f.node") == F.col("h.u"))
        new = f.select(
            F.col("h.v").alias("node"), (F.col("f.o") + F.col("h.o")).alias("o"), (F.col("f.r") + F.col("h.r")).alias("r"),
            F.concat("f.path", F.array(F.col("h.v").cast("string"))).alias("path"), F.concat("f.edge_path", F.array("h.edge_id")).alias("edge_path"), "h.rest_r", "h.rest_o",
        ).where((F.col("r") + F.col("rest_r") <= F.lit(cap)) & (F.col("o") + F.col("rest_o") < F.lit(float("inf") if best is None else best - EPS) if best is not None else F.col("r") + F.col("rest_r") <= F.lit(cap)))
        new = new.drop("rest_r", "rest_o").withColumn("_new", F.lit(True))
        kept = skyline(settled.withColumn("_new", F.lit(False)).unionByName(new), "node", "r", "o").checkpoint()
        frontier, settled = kept.where("_new").drop("_new"), kept.drop("_new")
        state = kept.agg(F.count_if("_new").alias("n"), F.min(F.when(F.col("node") == F.lit(destination), F.col("o"))).alias("best")).first()
        best = state["best"]
        if not state["n"]:
            break
    hop.unpersist()
    at_end = settled.where(F.col("node") == F.lit(destination))
    return at_end.orderBy("o", "r", "path").limit(1).select("path", "edge_path", F.col("o").alias("objective"), F.col("r").alias("resource"))


def path_totals(paths: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, distance, exposure, average, segments) summed over ``edge_path``; distance to 2 digits, exposure to 4."""
    steps = paths.select(key, F.posexplode("edge_path").alias("_i", "edge_id"))
    s = steps.join(edges.select("edge_id", "length", "risk_exposure"), "edge_id").groupBy(key).agg(F.sum("length").alias("d"), F.sum("risk_exposure").alias("x"), F.count("*").alias("segments"))
    return s.select(key, F.bround("d", 2).alias("distance"), F.bround("x", 4).alias("exposure"), F.coalesce(F.try_divide("x", "d"), F.lit(0.0)).alias("average"), "segments")


def nearest_node(nodes: DataFrame, lat: float, lon: float) -> DataFrame:
    """The node (node, x = lon, y = lat) nearest in degrees; one pass, one row."""
    d2 = F.pow(F.col("y") - F.lit(lat), 2) + F.pow(F.col("x") - F.lit(lon), 2)
    return nodes.where("x is not null and y is not null").agg(F.min_by("node", F.struct(d2, "node")).alias("node"))


@dataclass
class Local:
    """A graph in one worker."""

    out: dict = field(default_factory=lambda: defaultdict(list))
    back: dict = field(default_factory=lambda: defaultdict(list))

    @staticmethod
    def of(rows) -> Local:
        """From (u, v, edge_id, length, cmcs, safety_cost) rows; their order is the order of choice."""
        g = Local()
        for u, v, edge, length, cmcs, safety in rows:
            e = (v, edge, float(length), float(cmcs), float(safety))
            g.out[u].append(e)
            g.back[v].append((u, edge, float(length), float(cmcs), float(safety)))
            g.out[v], g.back[u]  # noqa: B018  both ends are nodes
        return g

    def has(self, node) -> bool:
        return node in self.out


def cost_of(edge, mode: str, lam: float = 0.5) -> float:
    """The objective of an edge of :class:`Local`."""
    _, _, length, cmcs, safety = edge
    return length if mode == "shortest" else safety if mode == "safest" else length * (lam + (1 - lam) * (RISK_FLOOR + cmcs))


def rest_to(g: Local, node, weight) -> tuple[dict, dict]:
    """Least weight from every node to ``node``, and the edge to take next."""
    dist, nxt, heap = {node: 0.0}, {}, [(0.0, 0, node)]
    n = 0
    while heap:
        d, _, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, edge, length, cmcs, safety in g.back[v]:
            e = (v, edge, length, cmcs, safety)
            if d + weight(e) < dist.get(u, float("inf")):
                dist[u], nxt[u] = d + weight(e), e
                n += 1
                heapq.heappush(heap, (dist[u], n, u))
    return dist, nxt


@dataclass
class Found:
    path: list
    edges: list
    objective: float
    distance: float
    exposure: float
    proven: bool = True
    expanded: int = 0
    dominated: int = 0
    bounded: int = 0


def make_found(origin, edges: list, mode: str, lam: float, **more) -> Found:
    return Found([origin, *[e[0] for e in edges]], [e[1] for e in edges], sum(cost_of(e, mode, lam) for e in edges), sum(e[2] for e in edges), sum(e[2] * e[3] for e in edges), **more)


def solve(g: Local, origin, destination, mode: str, limit: float | None = None, lam: float = 0.5, bound: float | None = None, deadline: float | None = None) -> Found | None:
    """The path of least objective within ``limit`` metres, best first, with dominance and admissible bounds at each node.

    ``bound``: an objective that is known to be reachable; nothing worse is followed. None if there is no path; not ``proven`` if the time ran out first.
    """
    if origin == destination:
        return Found([origin], [], 0.0, 0.0, 0.0)
    cap = float("inf") if limit is None else limit + EPS
    rest_r, _ = rest_to(g, destination, lambda e: e[2])
    rest_o, _ = rest_to(g, destination, lambda e: cost_of(e, mode, lam))
    if origin not in rest_r or rest_r[origin] > cap:
        return None
    top = float("inf") if bound is None else bound + EPS
    fronts: dict = defaultdict(list)
    heap = [(rest_o[origin], 0.0, 0, origin, 0.0, None)]
    n = expanded = dominated = bounded = 0
    while heap:
        if deadline is not None and time.perf_counter() > deadline:
            return None
        _, r, _, node, o, trail = heapq.heappop(heap)
        if node == destination:
            edges = []
            while trail:
                edges.append(trail[0])
                trail = trail[1]
            return make_found(origin, edges[::-1], mode, lam, expanded=expanded, dominated=dominated, bounded=bounded)
        if any(a <= r and b <= o + EPS for a, b in fronts[node]):
            dominated += 1
            continue
        fronts[node].append((r, o))
        expanded += 1
        for e in g.out[node]:
            v, nr, no = e[0], r + e[2], o + cost_of(e, mode, lam)
            if v not in rest_r or nr + rest_r[v] > cap or no + rest_o[v] > top:
                bounded += 1
                continue
            n += 1
            heapq.heappush(heap, (no + rest_o[v], nr, n, v, no, (e, trail)))
    return None
