"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``2 ** bin_bits`` equal bins.  Each shard owns ``vnodes``
pseudorandom bins' ends; a key belongs to the first such end clockwise from
its bin.  Keys enter in ring order; one that meets a full shard continues clockwise
to the next virtual node whose shard has room.  Capacities add up to the number
of rows and differ by one at most, so row counts are balanced exactly.

Only the number of rows of each bin reaches the driver (``2 ** bin_bits`` numbers,
whatever the input), where the walk is done for a bin's rows at once: they go in
rank order, first to the bin's own shard, then to those that follow.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 12
VNODES = 64


def ring_owners(shards: int, vnodes: int = VNODES, bin_bits: int = BIN_BITS) -> list[list[int]]:
    """For each bin the shards in the order in which a key from there meets them."""
    bins = 1 << bin_bits
    ends: dict[int, tuple[bytes, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            d = hashlib.sha256(f"{s}/{v}".encode()).digest()
            at = int.from_bytes(d[:4], "big") % bins
            ends[at] = min(ends.get(at, (b"\xff" * 33, 0)), (d, s))
    order = sorted(ends)
    met: dict[int, list[int]] = {}
    for i, at in enumerate(order):
        met[at] = list(dict.fromkeys([ends[x][1] for x in order[i:] + order[:i]] + list(range(shards))))
    out, i = [], 0
    for b in range(bins):
        while i < len(order) and order[i] < b:
            i += 1
        out.append(met[order[i % len(order)]])
    return out


def walk(counts: dict[int, int], shards: int, vnodes: int = VNODES, bin_bits: int = BIN_BITS) -> list[tuple[int, int, int, int, int]]:
    """(bin, from rank, to rank, shard, slot of the first) for the rows of each bin."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out = []
    for b, owners in enumerate(ring_owners(shards, vnodes, bin_bits)):
        rank, left = 0, counts.get(b, 0)
        for s in owners:
            if not left:
                break
            n = min(left, room[s] - filled[s])
            if n:
                out.append((b, rank, rank + n, s, filled[s]))
                filled[s] += n
                rank += n
                left -= n
    return out


def shard_rows(df: DataFrame, key: str, shards: int, vnodes: int = VNODES, bin_bits: int = BIN_BITS) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long (gapless from 0 within a shard).

    Rows are placed by the hash of ``key``; a null key is a key like any other.
    Rows with equal keys rank by the hash of all their columns; equal rows are
    interchangeable.  An empty table gives no rows.  Columns of ``df`` of the
    names ``shard`` or ``slot`` are replaced; carry only narrow columns, since
    rows are dealt by bin for ranking.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    at = F.xxhash64(F.col(key).cast("string"))
    placed = df.select(*own).withColumn("_at", at).withColumn("_bin", F.shiftrightunsigned("_at", 64 - bin_bits).cast("int"))
    counts = {r["_bin"]: r["count"] for r in placed.groupBy("_bin").count().collect()}
    parts = walk(counts, shards, vnodes, bin_bits)
    plan = df.sparkSession.createDataFrame(parts, "_bin int, _from long, _to long, shard int, _slot long")
    ranked = placed.withColumn("_tie", F.xxhash64(*own)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bin").orderBy("_at", F.col(key).cast("string"), "_tie", *own)) - 1
    )
    hit = ranked.join(F.broadcast(plan), (ranked["_bin"] == plan["_bin"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return hit.select(*own, "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"))


def op10_shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document under the law ``rows``; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(slim, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
