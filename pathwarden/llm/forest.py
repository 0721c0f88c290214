"""Near duplicates among vectors by a forest of random-projection trees.

Each tree splits by random directions at the median, and vectors within ``SPILL`` of the
ranks around the median go to both sides.  The upper splits are fitted on a
bounded sample (``SAMPLE_ROWS`` vectors drawn by the hash of their values) and sent to all executors; every vector is
sent down all trees.  What reaches the same cell of a tree meets in one task, which splits
on with all of the cell's vectors, until a leaf has ``LEAF`` vectors.  Pairs that share a leaf
are verified in double precision; links of all trees are united.

A split parts more links the closer a node's vectors lie together.  Each node, of the upper splits too, is judged
on a sample of its vectors: how many pairs link, and how often a random split parts such a pair.  Where links are
to be seen and all trees together would lose more than ``MISS`` of them, the node is
split no further but compared whole: in its task, or, for the upper splits, in pairs of blocks of about ``PART`` vectors, a task each.

Vectors with equal components are one vector with many ids throughout the search; its ids are
linked with each other, and the links of one are the links of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.llm.common import components, discard, stored

THRESHOLD = 0.9
TREES = 10
#: Where vectors lie so close together that ten trees would lose links, as many are grown as lose ``MISS`` of them, up to this.
MOST_TREES = 40
SPILL = 0.12
LEAF = 320
CELL = 4096
SAMPLE_ROWS = 32_768
SAMPLE_LEAST = 64
#: The share of links that all trees together may lose at a node before it is compared whole, and the share of pairs that has to link for that.
MISS = 0.005
DENSE = 1e-4
PART = 8192
SEED = 7
#: Vectors by which a node within a cell is judged: some 32,000 pairs, of which 3 link where ``DENSE`` do.
JUDGED = 256
_BLOCK = 1024
_CELLS = "tree int, cell int, part int, block int, rep long, v binary"
_LINKS = "a long, b long"


def usable(v) -> np.ndarray | None:
    """The vector in double precision at length one, or None where it links with nothing."""
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _direction(dim: int, *key: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim, *key])).standard_normal(dim)


def _judge(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[float, float]:
    """(share of pairs that link, chance that a random split parts a linked pair near the threshold) by a sample of a node."""
    n = len(x)
    if n < 2:
        return 0.0, 0.0
    dots = x @ x.T
    a, b = np.divmod(np.flatnonzero(dots >= threshold), n)
    a, b = a[a < b], b[a < b]
    # For vectors spread alike in all directions: the gap of a pair at the threshold beside the gap left by the spill.
    mean = x.mean(axis=0)
    ratio = math.sqrt(max(0.0, 2 * (1 - threshold)) / max(1e-12, 1 - float(mean @ mean)))
    at = 2 * NormalDist().inv_cdf(0.5 + SPILL) / ratio if ratio else math.inf
    expected = 2 * ratio * 0.3989 * (NormalDist().pdf(at) - at * NormalDist().cdf(-at)) if ratio else 0.0
    if not len(a):
        return 0.0, min(1.0, expected)
    # For any others: what splits do to the loosest linked pairs of the sample.
    loose = np.argsort(dots[a, b], kind="stable")[:64]
    p = x @ rng.standard_normal((x.shape[1], 32))
    ranked = np.sort(p, axis=0)
    lo, hi = (ranked[round((n - 1) * at)] for at in (0.5 - SPILL, 0.5 + SPILL))
    u, v = np.minimum(p[a[loose]], p[b[loose]]), np.maximum(p[a[loose]], p[b[loose]])
    return 2 * len(a) / (n * (n - 1)), min(1.0, max(expected, float(np.mean((u < lo) & (v > hi)))))


def _whole(dense: float, kept: float, parted: float, n: float, leaf: int, trees: int) -> bool:
    """Whether a node of ``n`` vectors, to which a tree has brought ``kept`` of the linked pairs, is compared whole."""
    levels = max(0.0, math.log(max(n, 1) / leaf) / -math.log(0.5 + SPILL))
    return dense > 0.25 or dense >= DENSE and (1 - kept * (1 - parted) ** levels) ** trees > MISS


def grow(sample: np.ndarray, tree: int, depth: int, threshold: float = THRESHOLD, rows: int = 0, trees: int = TREES) -> tuple[list[list[tuple[float, float]]], list[float], dict[int, float]]:
    """(by level and node the (low, high) bounds: below low goes left, above high right, between both ways;
    by cell the share of linked pairs that is expected to reach it unparted; cells to compare whole with their expected vectors of ``rows``).

    A node to compare whole has infinite bounds: all goes left.
    """
    rng = np.random.Generator(np.random.PCG64([SEED, tree]))
    groups, out, kept, whole = [np.arange(len(sample))], [], [1.0], [False]
    rows = rows or len(sample)
    for level in range(depth):
        row, following, shares, stays = [], [], [], []
        for node, g in enumerate(groups):
            parted = 0.0
            if not whole[node]:
                dense, parted = _judge(sample[g[:1024]], threshold, rng)
                whole[node] = _whole(dense, kept[node], parted, rows * len(g) / max(1, len(sample)), LEAF, trees)
            p = sample[g] @ _direction(sample.shape[1], tree, level, node)
            lo, hi = (np.quantile(p, 0.5 - SPILL), np.quantile(p, 0.5 + SPILL)) if len(p) else (0.0, 0.0)
            if whole[node]:
                lo = hi = math.inf
            row.append((float(lo), float(hi)))
            following += [g[p <= hi], g[p >= lo]]
            shares += [kept[node] * (1 - parted if not whole[node] else 1.0)] * 2
            stays += [whole[node], False]
        out.append(row)
        groups, kept, whole = following, shares, stays
    return out, kept, {c: rows * len(groups[c]) / max(1, len(sample)) for c, w in enumerate(whole) if w}


def trees_needed(sample: np.ndarray, grown: tuple, rows: int, threshold: float = THRESHOLD, least: int = TREES, most: int = MOST_TREES) -> int:
    """How many trees lose at most ``MISS`` of the links, judged by one tree: what its splits down to the leaves leave together, averaged over its vectors.

    Nodes without a link in their sample are judged as if vectors were spread alike in all directions about their mean.
    """
    bounds, kept, whole = grown
    rng = np.random.Generator(np.random.PCG64([SEED, 0x7EED]))
    weight, share = [], []
    for c, g in cells(sample, 0, bounds):
        if c in whole or len(g) < 2:
            continue
        _, parted = _judge(sample[g[:1024]], threshold, rng)
        levels = max(0.0, math.log(max(1.0, rows * len(g) / len(sample) / LEAF)) / -math.log(0.5 + SPILL))
        weight.append(len(g))
        share.append(kept[c] * (1 - parted) ** levels)
    w, k = np.array(weight, float), np.array(share)
    return next((t for t in range(least, most) if not len(w) or float(w @ (1 - k) ** t) <= MISS * w.sum()), most)


def cells(x: np.ndarray, tree: int, bounds: list[list[tuple[float, float]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, indexes of the vectors that reach it)."""
    groups = [(0, np.arange(len(x)))]
    for level, row in enumerate(bounds):
        following = []
        for node, g in groups:
            p = x[g] @ _direction(x.shape[1], tree, level, node)
            lo, hi = row[node]
            following += [(2 * node, g[p <= hi]), (2 * node + 1, g[p >= lo])]
        groups = [(n, g) for n, g in following if len(g)]
    yield from groups


def _compare(x: np.ndarray, ids: np.ndarray, g: np.ndarray, threshold: float, h: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Linked pairs within ``g``, or between ``g`` and ``h``, as rows (smaller id, larger id)."""
    within, h = h is None, g if h is None else h
    for i in range(0, len(g), _BLOCK):
        for j in range(i if within else 0, len(h), _BLOCK):
            p, q = np.nonzero(x[g[i : i + _BLOCK]] @ x[h[j : j + _BLOCK]].T >= threshold)
            a, b = ids[g[i + p]], ids[h[j + q]]
            if within and i == j:
                a, b = a[p < q], b[p < q]
            if len(a):
                yield np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def leaves(x: np.ndarray, key: tuple[int, ...], threshold: float, leaf: int = LEAF, kept: float = 1.0, trees: int = TREES) -> Iterator[np.ndarray]:
    """Groups of indexes to compare: recursive random splits with spill of vectors to which ``kept`` of the linked pairs came unparted."""
    rng = np.random.Generator(np.random.PCG64([SEED, *key]))
    stack = [(np.arange(len(x)), kept)]
    while stack:
        g, kept = stack.pop()
        if len(g) <= leaf:
            yield g
            continue
        dense, parted = _judge(x[g[rng.choice(len(g), min(JUDGED, len(g) // 2), replace=False)]], threshold, rng)
        if _whole(dense, kept, parted, len(g), leaf, trees):
            yield g
            continue
        p = x[g] @ rng.standard_normal(x.shape[1])
        lo, hi = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        left, right = g[p <= hi], g[p >= lo]
        if len(left) == len(g) or len(right) == len(g):
            yield g
        else:
            stack += [(left, kept * (1 - parted)), (right, kept * (1 - parted))]


def links(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, cell: int = CELL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Linked pairs (a, b), a < b, of ``vectors`` (rep, v: unit vectors of one length as double bytes)."""
    spark = vectors.sparkSession
    n = vectors.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / cell)))
    depth = min(depth, max(0, int(math.log2(max(1, sample_rows // SAMPLE_LEAST)))))
    grown: list = [([], [1.0], {}) for _ in range(trees)]
    if n > LEAF:
        # A bounded sample, whatever the input: it only places splits and says how many trees are needed.
        got = vectors.orderBy(F.xxhash64("v"), "rep").select("v").limit(min(sample_rows, max(1024, SAMPLE_LEAST << depth))).collect()
        sample = np.frombuffer(b"".join(bytes(r["v"]) for r in got), np.float64).reshape(len(got), -1)
        first = grow(sample, 0, depth, threshold, n, trees)
        trees = trees_needed(sample, first, n, threshold, trees, max(trees, MOST_TREES))
        grown = [grow(sample, t, depth, threshold, n, trees) for t in range(trees)]
        # Where a tree compares all vectors with each other, the others have nothing to add.
        grown = next(([one] for one in grown if depth and one[0][0][0][0] == math.inf), grown)
    shared = spark.sparkContext.broadcast([(bounds, kept, {c: math.ceil(m / PART) for c, m in whole.items()}) for bounds, kept, whole in grown])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, raw = b.column(0).to_numpy(), b.column(1)
            x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(b.num_rows, -1)
            deal = np.random.Generator(np.random.PCG64([SEED, int(rep[0])])).integers(0, 1 << 30, b.num_rows)
            for t, (bounds, _, whole) in enumerate(shared.value):
                for c, g in cells(x, t, bounds):
                    blocks = whole.get(c, 0)
                    block = deal[g] % max(1, blocks)
                    # A vector of a whole cell meets those of each block in one task.
                    for other in range(max(1, blocks)):
                        part = np.minimum(block, other) * blocks + np.maximum(block, other) if blocks else np.full(len(g), -1)
                        one = [pa.array(np.asarray(k, np.int32)) for k in (np.full(len(g), t), np.full(len(g), c), part, block)]
                        yield pa.RecordBatch.from_arrays([*one, pa.array(rep[g]), raw.take(pa.array(g))], ["tree", "cell", "part", "block", "rep", "v"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames))
        ids, block = frame["rep"].to_numpy(), frame["block"].to_numpy()
        tree, at, part = (int(frame[k].iat[0]) for k in ("tree", "cell", "part"))
        x = np.frombuffer(b"".join(frame["v"]), np.float64).reshape(len(ids), -1)
        del frame
        order = np.argsort(ids, kind="stable")
        x, ids, block = x[order], ids[order], block[order]
        _, kept, whole = shared.value[tree]
        if part >= 0:
            low, high = divmod(part, whole[at])
            for pairs in _compare(x, ids, np.flatnonzero(block == low), threshold, None if low == high else np.flatnonzero(block == high)):
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
            return
        found, parts = [], 0
        for g in leaves(x, (tree, at), threshold, kept=kept[at], trees=trees):
            for pairs in _compare(x, ids, g, threshold):
                found.append(pairs)
                parts += len(pairs)
                if parts > 1 << 21:
                    # A pair may come again from another leaf: distinct() below unites such.
                    pairs = np.unique(np.concatenate(found), axis=0)
                    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
                    found, parts = [], 0
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return vectors.select("rep", "v").mapInArrow(route, _CELLS).groupBy("tree", "cell", "part").applyInPandas(search, _LINKS).distinct()


def op1_forest(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different lengths.
    Rows that repeat a vec_id are vectors of their own; a null vec_id is not less than any other.
    """

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if (x := usable(v)) is None else x.tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(norm, "vec_id long, v binary").withColumn("row", F.monotonically_increasing_id())
    # Vectors are told apart by 128 bits of hash; those that link with nothing have a half key, which meets none.
    rows = rows.select("vec_id", "row", "v", F.coalesce(F.when(F.col("v").isNotNull(), F.xxhash64("v")), F.col("row")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(SEED), "v")).alias("k"))
    rows, rows_path = stored(rows, "vectors")
    groups, groups_path = stored(rows.where("v is not null").groupBy("h", "k").agg(F.first("v").alias("v"), F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("n")), "vector-groups")
    found = None
    for r in groups.groupBy(F.length("v").alias("bytes")).count().collect():  # one forest for each length of vector
        part = links(groups.where(F.length("v") == r["bytes"]), threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], _LINKS)
    pairs, pairs_path = stored(found, "vector-links")
    size = groups.select("rep", "n", "least")
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    degree = both.join(size.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comp, comp_path = components(pairs)
    labelled = size.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    least = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    per_group, per_path = stored(labelled.join(least, "c").select("rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-classes")
    discard(embeddings.sparkSession, pairs_path, comp_path)
    member = rows.select("vec_id", "h", "k").join(groups.select("h", "k", "rep"), ["h", "k"], "left").select("vec_id", "rep").join(per_group, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return member.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
