"""Requests in, responses out: what a service would answer, for single requests and for tables of them."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.functions.roads import AGE_PROFILES, age_profile
from pathwarden.operators import graph, reports, routes

MODES = ("shortest", "safest", "balanced")


class Invalid(ValueError):
    """A request that can't be answered as it is."""


@dataclass(frozen=True)
class RouteRequest:
    origin: tuple[float, float]
    destination: tuple[float, float]
    mode: str = "balanced"
    age_group: str = "mid"
    hour: int = 8
    lam: float | None = None

    def __post_init__(self):
        for lat, lon in (self.origin, self.destination):
            if not (-90 <= lat <= 90 and -180 <= lon <= 180):
                raise Invalid("latitude or longitude out of bounds")
        if self.mode not in MODES:
            raise Invalid(f"mode must be one of {MODES}")
        if self.age_group not in [p[0] for p in AGE_PROFILES]:
            raise Invalid("unknown age group")
        if not 0 <= self.hour <= 23:
            raise Invalid("hour must be within 0 and 23")
        if self.lam is not None and not 0 <= self.lam <= 1:
            raise Invalid("lam must be within 0 and 1")


@dataclass
class TTLCache:
    """Answers by the digest of a request; the expired go first, then the oldest."""

    ttl: float = 300.0
    size: int = 2048
    clock: object = time.monotonic
    _kept: dict = field(default_factory=dict)
    hits: int = 0

    @staticmethod
    def key(request) -> str:
        return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def get(self, key: str):
        at = self._kept.get(key)
        if at is None or self.clock() - at[0] > self.ttl:
            self._kept.pop(key, None)
            return None
        self.hits += 1
        return at[1]

    def put(self, key: str, value) -> None:
        now = self.clock()
        if len(self._kept) >= self.size:
            self._kept = {k: v for k, v in self._kept.items() if now - v[0] <= self.ttl}
        while len(self._kept) >= self.size:
            self._kept.pop(min(self._kept, key=lambda k: self._kept[k][0]))
        self._kept[key] = (now, value)


class Engine:
    """A graph and places, ready for requests.

    ``nodes`` has node, x (lon) and y (lat); ``edges`` u, v, edge_id, length and cmcs; ``places`` name, address, district, lat, lon.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, places: DataFrame | None = None):
        self.nodes, self.edges, self.places = nodes.persist(), graph.edge_costs(edges).persist(), places
        self.routes, self.searches = TTLCache(), TTLCache(3600.0, 512)

    def health(self) -> dict:
        n, e = self.nodes.count(), self.edges.count()
        return {"ready": n > 0 and e > 0, "nodes": n, "edges": e, "cache_hits": self.routes.hits + self.searches.hits}

    def _node(self, at: tuple[float, float]):
        r = graph.nearest_node(self.nodes, *at).first()
        if r is None or r["node"] is None:
            raise Invalid("no node has coordinates")
        return str(r["node"])

    def recommend(self, request: RouteRequest) -> dict:
        key = TTLCache.key(["recommend", request.__dict__])
        if (got := self.routes.get(key)) is not None:
            return got
        lam, most = age_profile(request.age_group)
        lam = request.lam if request.lam is not None else lam
        pair = self.edges.sparkSession.createDataFrame([(self._node(request.origin), self._node(request.destination))], "origin string, destination string")
        rows = {r["mode"]: r.asDict() for r in routes.compare(self.edges, pair, most, lam).collect()}
        if request.mode not in rows:
            raise Invalid("there is no such route within the detour")
        self.routes.put(key, rows[request.mode])
        return rows[request.mode]

    def compare(self, origin: tuple[float, float], destination: tuple[float, float], max_detour: float | None = None) -> list[dict]:
        """Three modes beside the shortest; a detour is limited only where asked for."""
        pair = self.edges.sparkSession.createDataFrame([(self._node(origin), self._node(destination))], "origin string, destination string")
        return [r.asDict() for r in routes.compare(self.edges, pair, max_detour).collect()]

    def recommend_many(self, requests: DataFrame) -> DataFrame:
        """Answers to a table of (origin, destination, mode, age_group): nodes are given, requests are dealt to all executors."""
        ages = self.edges.sparkSession.createDataFrame(AGE_PROFILES, "age_group string, lam double, most double")
        r = requests.join(F.broadcast(ages), "age_group").persist()
        base = routes.route_many(self.edges, routes.requests(r.select("origin", "destination").distinct(), [("shortest", None)]))
        limits = base.select("origin", "destination", F.col("distance").alias("_d"))
        req = r.join(limits, ["origin", "destination"]).select("origin", "destination", "mode", "lam", F.when(F.col("mode") == "shortest", None).otherwise(F.col("_d") * F.col("most")).alias("limit"))
        return routes.route_many(self.edges, req)

    def search(self, query: str | None, district: str | None = None) -> list[dict]:
        key = TTLCache.key(["search", query, district])
        if (got := self.searches.get(key)) is None:
            got = [r.asDict() for r in reports.search(self.places, query, district).collect()]
            self.searches.put(key, got)
        return got
