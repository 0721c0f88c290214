"""Ant colony search and its combination with exact search; one run is one worker's work, runs are dealt to workers."""

from __future__ import annotations

import random
import statistics
import time
from dataclasses import dataclass, field

from pathwarden.operators.graph import EPS, Found, Local, cost_of, make_found, rest_to, solve


@dataclass(frozen=True)
class Colony:
    """The numbers of a colony; the defaults are fixed values."""

    ants: int = 32
    iterations: int = 40
    alpha: float = 1.0
    beta: float = 2.0
    start: float = 2.0
    evaporation: float = 0.30
    floor: float = 1e-6
    deposit: float = 100.0
    elite: int = 3
    connector: float = 0.35
    steps: int = 256
    alternatives: int = 3
    seed: int = 42


@dataclass
class ColonyResult:
    best: Found | None
    source: str | None
    pure: int = 0
    seeded: int = 0
    ants: int = 0
    iterations: int = 0
    best_iteration: int | None = None
    history: list = field(default_factory=list)


def _walk(g: Local, origin, destination, mode: str, lam: float, cap: float, c: Colony, trail: dict, rest: dict, tail: dict, rng: random.Random):
    """(edges, source) of one ant, or None."""
    node, used, edges, seen, forks = origin, 0.0, [], {origin}, []
    for step in range(c.steps):
        if node == destination:
            return edges, "pure"
        options = [e for e in g.out[node] if e[0] not in seen and e[0] in rest and used + e[2] + rest[e[0]] <= cap]
        # The rest of a known path: by chance, and always where no step is left.
        if not options or step and rng.random() < c.connector:
            got, at, fresh = [], node, set(seen)
            while at != destination and at in tail:
                e = tail[at]
                if e[0] in fresh:
                    break
                got.append(e)
                at = e[0]
                fresh.add(at)
            if at == destination and used + sum(e[2] for e in got) <= cap:
                return edges + got, "seeded"
        if not options:
            if not forks:
                return None
            node, used, edges, seen, e = forks.pop()
        else:
            pull = [(trail[_key(node, e)] ** c.alpha) * ((1 / (cost_of(e, mode, lam) + 0.05 * e[2] + EPS)) * (1 + 0.25 / (1 + rest[e[0]]))) ** c.beta for e in options]
            e = rng.choices(options, pull)[0] if sum(pull) > 0 else rng.choice(options)
            others = [x for _, x in sorted(zip(pull, options), key=lambda p: -p[0]) if x is not e]
            forks += [(node, used, list(edges), set(seen), x) for x in others[: c.alternatives]]
        used += e[2]
        edges = [*edges, e]
        seen = seen | {e[0]}
        node = e[0]
    return (edges, "pure") if node == destination else None


def _key(u, e) -> tuple:
    return (frozenset((u, e[0])), e[1])


def colony(g: Local, origin, destination, mode: str, limit: float | None = None, lam: float = 0.5, c: Colony = Colony(), budget: float | None = None) -> ColonyResult:  # noqa: B008
    """The best path that the ants find within ``limit``; without any, the path of least objective if that fits."""
    if origin == destination:
        return ColonyResult(Found([origin], [], 0.0, 0.0, 0.0), "pure", pure=1, best_iteration=0)
    began, rng = time.perf_counter(), random.Random(c.seed)
    cap = float("inf") if limit is None else limit + EPS
    rest, tail = rest_to(g, destination, lambda e: e[2])
    trail = {_key(u, e): c.start for u in list(g.out) for e in g.out[u]}
    out = ColonyResult(None, None)
    for it in range(1, c.iterations + 1):
        if budget is not None and time.perf_counter() - began > budget:
            break
        found = []
        for _ in range(c.ants):
            out.ants += 1
            got = _walk(g, origin, destination, mode, lam, cap, c, trail, rest, tail, rng)
            if got:
                found.append((make_found(origin, got[0], mode, lam), got[0], got[1]))
        out.iterations = it
        out.pure += sum(s == "pure" for _, _, s in found)
        out.seeded += sum(s == "seeded" for _, _, s in found)
        found.sort(key=lambda x: (x[0].objective, x[0].distance))
        if found and (out.best is None or (found[0][0].objective, found[0][0].distance) < (out.best.objective - EPS, out.best.distance)):
            out.best, out.source, out.best_iteration, best_edges = found[0][0], found[0][2], it, found[0][1]
        for k in trail:
            trail[k] = max(c.floor, trail[k] * (1 - c.evaporation))
        rewarded = found[: c.elite] + ([(out.best, best_edges, "")] if out.best else [])
        for f, edges, _ in rewarded:
            u = origin
            for e in edges:
                trail[_key(u, e)] += c.deposit / (f.objective + EPS)
                u = e[0]
        objectives = [f.objective for f, _, _ in found]
        out.history.append({
            "iteration": it, "iteration_best": found[0][0].objective if found else None, "best_objective": out.best.objective if out.best else None, "feasible_ants": len(found), "success_rate": round(len(found) / c.ants, 6),
            "mean_objective": round(statistics.fmean(objectives), 6) if objectives else None, "std_objective": round(statistics.pstdev(objectives), 6) if objectives else None,
        })
    if out.best is None:
        rest_o, nxt = rest_to(g, destination, lambda e: cost_of(e, mode, lam))
        if origin in rest_o:
            at, edges = origin, []
            while at != destination:
                edges.append(nxt[at])
                at = nxt[at][0]
            f = make_found(origin, edges, mode, lam)
            if f.distance <= cap:
                out.best, out.source, out.best_iteration = f, "fallback", 0
    return out


@dataclass
class HybridResult:
    found: Found | None
    source: str
    ants: ColonyResult
    exact_objective: float | None
    proven: bool


def hybrid(g: Local, origin, destination, mode: str, limit: float | None = None, lam: float = 0.5, c: Colony = Colony(), budget: float | None = None) -> HybridResult:  # noqa: B008
    """Ants give a bound in 35 % of the time, exact search proves or betters it in the rest."""
    for node in (origin, destination):
        if not g.has(node):
            raise KeyError(f"no node {node!r}")
    began = time.perf_counter()
    a = colony(g, origin, destination, mode, limit, lam, c, None if budget is None else max(0.35 * budget, 0.0))
    late = budget is not None and budget <= 0
    exact = None if late else solve(g, origin, destination, mode, limit, lam, a.best.objective if a.best else None, None if budget is None else began + budget)
    if exact is not None:
        return HybridResult(exact, "rcsp_certified", a, exact.objective, True)
    return HybridResult(a.best, "aco_approx" if a.best else "none", a, None, False)
