"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

Rows are hashed where they are read; from there on only digests move.  The rows of a group, in order, are cut into aligned
blocks of ``8 ** BLOCK_LEVELS``.  A block's root is the leaf of the next round, until a group has one root; the roots of
groups make the last tree, in the same way.  Then, from the top down, a block is traversed by fractal traversal: levels are cut
into bands, of each of which one existing subtree (around the present leaf) and the growing stack of the desired one (the next to the right)
are kept, so the successive authentication paths of a block's leaves come out with nodes for a few subtrees in memory.  The upper part of a path, made by the
rounds above, is the same for a whole block and is appended to each.

Runs are of 8 nodes; the last run of a level may be shorter, down to one node, which is hashed all the same.  A level of one
node is the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwarden.llm.common import stored
from pathwarden.operators.ordering import numbered

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels of a block, and of a band of subtrees within it.
BLOCK_LEVELS = 4
BAND_LEVELS = 2
PATH = "array<struct<before:string,after:string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def combine(digests: Sequence[str]) -> str:
    """SHA-256 of hex digests written one after another."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Growing:
    """A subtree under construction: leaves are pushed one at a time, finished nodes of levels ``low`` to ``high - 1`` are kept.

    Besides these, it holds at most one unfinished run a level.
    """

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]
        self._runs: list[list[str]] = [[] for _ in range(high)]
        self.root: str | None = None

    def push(self, digest: str, level: int = 0) -> None:
        while True:
            if level == self.high:
                self.root = digest
                return
            if level >= self.low:
                self.nodes[level - self.low].append(digest)
            run = self._runs[level]
            run.append(digest)
            if len(run) < ARITY:
                return
            digest, self._runs[level], level = combine(run), [], level + 1

    def finish(self) -> None:
        """Close the runs that the last leaf left open."""
        for level in range(self.high):
            if run := self._runs[level]:
                self._runs[level] = []
                self.push(combine(run), level + 1)


def block_root(leaves: Sequence[str], levels: int) -> str:
    tree = Growing(levels, levels)
    for x in leaves:
        tree.push(x)
    tree.finish()
    return tree.root


def traverse(leaves: Sequence[str], levels: int, band: int = BAND_LEVELS) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn its path up to ``levels``: per level the siblings before and after, each as one string."""
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    span = [ARITY**high for _, high in bands]
    existing = [Growing(low, high) for low, high in bands]
    for k, tree in enumerate(existing):
        for x in leaves[: span[k]]:
            tree.push(x)
        tree.finish()
    desired = [Growing(low, high) for low, high in bands]
    for i in range(len(leaves)):
        path = []
        for k, (low, high) in enumerate(bands):
            if i and i % span[k] == 0:
                desired[k].finish()
                existing[k], desired[k] = desired[k], Growing(low, high)
            for level in range(low, high):
                nodes = existing[k].nodes[level - low]
                at = (i % span[k]) >> (ARITY_BITS * level)
                start = at & -ARITY
                path.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + ARITY])))
            # One leaf of the next subtree for each leaf of this one: it is whole when its turn comes.
            if i + span[k] < len(leaves):
                desired[k].push(leaves[i + span[k]])
        yield path


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for before, after in path:
        leaf = combine([before, leaf, after])
    return leaf


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """:func:`fold` as an expression."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def row_digest(columns: Sequence[Column | str]) -> Column:
    """SHA-256 of the columns' values: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for c in columns:
        v = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("i", ARITY_BITS * block))


def _roots(nodes: DataFrame, block: int) -> DataFrame:
    """The next round's nodes (g, i, n, h) from those of one round.

    A block reaches up ``block`` levels, or to the only root of its group.
    """

    def run(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        root = block_root(t.sort_by("i")["h"].to_pylist(), min(height(n), block))
        row = [pa.array([x], pa.int64()) for x in (t["g"][0].as_py(), t["block"][0].as_py(), -(-n // ARITY**block))]
        return pa.table([*row, pa.array([root])], names=["g", "i", "n", "h"])

    return _blocked(nodes, block).select("g", "block", "i", "n", "h").groupBy("g", "block").applyInArrow(run, "g long, i long, n long, h string")


def _climb(nodes: DataFrame, most: int, block: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes below the roots, and the roots (g, i = 0, n = 1, h).

    ``most`` is the size of the largest group.  Each round has 8 ** ``block`` times fewer nodes and is stored.
    """
    rounds = []
    while not rounds or most > 1:
        rounds.append(nodes)
        nodes, _ = stored(_roots(nodes, block), "roots")
        most = -(-most // ARITY**block)
    return rounds, nodes


def _proofs(cols: list[str], block: int, read: bool):
    """The function of one block: its nodes and the row of its root."""

    def run(t: pa.Table, upper: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        tail = [(p["before"], p["after"]) for p in upper["path"][0].as_py()]
        paths = traverse(t["h"].to_pylist(), min(height(t["n"][0].as_py()), block))
        subroot = pa.array([upper["subroot"][0].as_py()] * t.num_rows, pa.string())
        if not read:
            whole = pa.array([[{"before": b, "after": a} for b, a in p + tail] for p in paths], pa.list_(_STEP))
            return pa.table([*(t[c] for c in cols), subroot, whole], names=[*cols, "subroot", "path"])
        # Digests of one path after another: only one is in memory at a time.
        proofs, roots = [], []
        end = "".join(b + a for b, a in tail)
        for path, leaf in zip(paths, t["read"].to_pylist()):
            proofs.append(combine([*(b + a for b, a in path), end]))
            roots.append(fold(fold(leaf, path), tail))
        return pa.table([*(t[c] for c in cols), subroot, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], names=[*cols, "subroot", "proof", "folded"])

    return run


def _descend(rounds: list[DataFrame], above: DataFrame, block: int) -> DataFrame:
    """The first round's nodes with subroot and whole path, from ``above``: (g, i, subroot, path) of the roots.

    Nodes with a digest ``read`` get the digest of their path and the root that it leads to from there instead.
    """
    for nodes in reversed(rounds):
        read = "read" in nodes.columns
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", subroot string, " + ("proof string, folded string" if read else f"path {PATH}")
        mine = _blocked(nodes, block).groupBy("g", "block")
        roots = above.select("g", F.col("i").alias("block"), "subroot", "path").groupBy("g", "block")
        above = mine.cogroup(roots).applyInArrow(_proofs(nodes.columns, block, read), schema)
    return above


def manifest(rows: DataFrame, leaf: str, group: str, order: Sequence[Column | str], keep: Sequence[str], read: Column | None = None, block: int = BLOCK_LEVELS) -> DataFrame:
    """``keep`` columns, leaf, subroot, root, and path (siblings before and after, level by level up to the root).

    With ``read``, a digest of each row as it is read again, there are proof (the digest of the path) and folded (the root that
    ``read`` and the path lead to) instead of path, which then never leaves its task.

    A tree per value of ``group`` over its leaves in ``order``; groups ascend by their UTF-8 bytes, null first, and their roots
    make the upper tree.  Rows that tie in ``order`` are placed in an order of their own, so let the leaf be the last key.
    No rows give no rows.  ``rows`` is sorted and read several times: it should be narrow and stored.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    groups, _ = stored(numbered(sizes, [F.col(group).asc_nulls_first()], "_g", keep=lambda df: stored(df, "groups")[0]), "groups")
    shape = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    placed = numbered(rows, order, "_i", by=[group], keep=lambda df: stored(df, "placed")[0], per_group=groups)
    columns = (F.col("_g").alias("g"), F.col("_i").alias("i"), F.col("_n").alias("n"), F.col(leaf).alias("h"), F.struct(*keep).alias("kept"), *([] if read is None else [read.alias("read")]))
    leaves, _ = stored(placed.select(*columns), "leaves")

    rounds, subroots = _climb(leaves, shape["most"], block)
    nodes = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(shape["groups"]).cast("long").alias("n"), "h")
    tops, top = _climb(nodes, shape["groups"], block)
    root = top.first()
    ends = _descend(tops, top.select("g", "i", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path")), block)
    above = ends.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), F.col("h").alias("subroot"), "path")
    found = _descend(rounds, above, block)
    return found.select("kept.*", F.col("h").alias("leaf"), "subroot", F.lit(root and root["h"]).cast("string").alias("root"), *(["path"] if read is None else ["proof", "folded"]))


def op13_merkle(docs: DataFrame) -> DataFrame:
    """Manifest of documents, and for every row whether it, tampered with where the contract says so, still leads to the root.

    Rows are leaves of their own, repeated ones too (rows alike in doc_id rank by their leaf).  A null doc_id comes first, is written ``-`` and isn't
    tampered with; a null text or any other null column is ``-``.  Long texts are hashed whole where they are read.  No rows give no rows.
    Other columns play no part, whatever their names.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    slim = docs.select("doc_id", "lang", row_digest(columns).alias("leaf"), F.when(hit, row_digest([*columns[:-1], lowered])).alias("tampered"))
    rows, _ = stored(slim, "digests")
    order = [F.col("doc_id").asc_nulls_first(), "leaf"]
    got = manifest(rows, "leaf", "lang", order, keep=["doc_id"], read=F.coalesce("tampered", "leaf"))
    return got.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
