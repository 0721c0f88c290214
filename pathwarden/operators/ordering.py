"""Places, running sums and exact quantiles in a total order, without a task that sees all rows.

Rows are dealt to range partitions of the order, sorted there and stored together
with their place in their partition.  What comes before a partition is then known
from one number per partition, which is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.storage import cut, discard, stored

#: Values that one aggregation buffer, or rows that one window, may hold; beyond that many, work is dealt out.
AT_ONCE = 2_000_000
_GRID = 256
_SKETCH = 20_000

AT, PART = "_at", "_part"
_AT, _PART, _FIRST, _BEFORE = AT, PART, "_first", "_before"


def dealt(df: DataFrame, order: Sequence[Column | str], keep: Callable[[DataFrame], DataFrame] = cut, parts: int | None = None) -> DataFrame:
    """``df`` stored in range partitions of ``order``, with ``AT``, which ascends in ``order``, and ``PART``, the partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    return keep(placed).withColumn(_PART, F.shiftright(_AT, 33))


def numbered(df: DataFrame, order: Sequence[Column | str], out: str, by: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = cut, parts: int | None = None,
             per_group: DataFrame | None = None) -> DataFrame:
    """``df`` and ``out``, the place from 0 of each row among those with equal ``by`` (nulls are equal), in ``order``.

    Rows that tie in ``order`` get different places, in no stated order, that stay the same since the sorted rows are
    stored (by ``keep``, which cuts the lineage).  The window below sees at most one row per range partition and group.
    ``per_group`` has further columns for each value of ``by``; they join one row per group and range partition, so a large
    group is no hot key.
    """
    placed = dealt(df, [*by, *order], keep, parts)
    counts = placed.groupBy(*by, _PART).agg(F.count(F.lit(1)).alias("_n"), F.min(_AT).alias(_FIRST))
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(_PART).alias("_its"), _FIRST, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(_BEFORE))
    more = []
    if per_group is not None:
        more = [c for c in per_group.columns if c not in by]
        theirs = per_group.select(*(F.col(c).alias(f"_of_{c}") for c in by), *more)
        starts = starts.join(theirs, reduce(and_, (starts[f"_by_{c}"].eqNullSafe(theirs[f"_of_{c}"]) for c in by)))
    same = reduce(and_, (placed[c].eqNullSafe(starts[f"_by_{c}"]) for c in by), placed[_PART] == starts["_its"])
    return placed.join(starts if by else F.broadcast(starts), same).select(*df.columns, *more, (F.col(_BEFORE) + F.col(_AT) - F.col(_FIRST)).alias(out))


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str], by: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = cut, parts: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``df`` and, for each ``sums`` item (new name, column), the sum of the column up to and with the row in ``order``, among rows with equal ``by`` (nulls are equal).

    ``order`` should tell rows apart: group by its columns first.  Nulls add nothing.  Up to ``at_once`` rows, counted first, one window a group does.
    """
    df = keep(df)
    if df.limit(at_once + 1).count() <= at_once:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(k) for k, c in sums.items()))
    placed = dealt(df, [*by, *order], keep, parts)
    totals = placed.groupBy(*by, _PART).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{k}") for k, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as range partitions
    starts = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(_PART).alias("_its"), *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums))
    own = Window.partitionBy(*by, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_o_{k}") for k, c in sums.items()))
    same = reduce(and_, (inside[c].eqNullSafe(starts[f"_by_{c}"]) for c in by), inside[_PART] == starts["_its"])
    return inside.join(starts if by else F.broadcast(starts), same).select(*df.columns, *((F.col(f"_b_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]], rows: int | None = None, at_once: int = AT_ONCE) -> dict[str, list[float] | None]:
    """Exact quantiles, interpolated, of several expressions: name to values, None where there is none.  Nulls don't count.

    Up to ``at_once`` rows (``rows``, or counted here) one aggregation holds the values.  Beyond, each rank that is sought is closed in:
    a sketch gives two values with the rank between them, a count says how many values lie below and between, and so on within these until few
    enough distinct values are left for one buffer.  All expressions share each pass, over values that are stored once.
    """
    if not wanted:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= at_once:
        r = df.agg(*(F.percentile(x, list(ps)).alias(f"q{i}") for i, (x, ps) in enumerate(wanted.values()))).first()
        return {name: r[f"q{i}"] and list(r[f"q{i}"]) for i, name in enumerate(wanted)}
    d, at = stored(df.select(*(x.cast("double").alias(f"x{i}") for i, (x, _) in enumerate(wanted.values()))))
    try:
        return _closed_in(d, wanted, at_once)
    finally:
        discard(df.sparkSession, at)


def counted_quantiles(df: DataFrame, value: str, n: str, ps: Sequence[float]) -> list[float] | None:
    """Exact quantiles, interpolated, of ``value`` where each row stands for ``n`` alike; None where there is none.  Nulls don't count."""
    c = running(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.sum(n).alias("_n")), ["_v"], {"_c": "_n"})
    total = c.agg(F.max("_c")).first()[0]
    if not total:
        return None
    at = [p * (total - 1) for p in ps]
    ranks = sorted({f(k) for k in at for f in (math.floor, math.ceil)})
    found = dict(zip(ranks, c.agg(*(F.min(F.when(F.col("_c") > k, F.col("_v"))).alias(f"v{k}") for k in ranks)).first()))
    return [(a := found[math.floor(k)]) + (found[math.ceil(k)] - a) * (k - math.floor(k)) for k in at]


def _closed_in(d: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]], at_once: int) -> dict[str, list[float] | None]:
    n = d.agg(*(F.count(c).alias(c) for c in d.columns)).first()
    ranks = {}  # (column, rank) to [from value, to value, values below, values from - to]
    for c, (_, ps) in zip(d.columns, wanted.values()):
        for p in ps if n[c] else ():
            k = p * (n[c] - 1)
            ranks |= {(c, math.floor(k)): [-math.inf, math.inf, 0, n[c]], (c, math.ceil(k)): [-math.inf, math.inf, 0, n[c]]}
    grid = [i / _GRID for i in range(_GRID + 1)]
    between = lambda c, lo, hi: F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.col(c))
    while open_ := {k: v for k, v in ranks.items() if v[3] > at_once and v[0] < v[1]}:
        spans = list({(c, lo, hi) for (c, _), (lo, hi, _, _) in open_.items()})
        got = d.agg(*(F.percentile_approx(between(*span), grid, _SKETCH).alias(f"s{i}") for i, span in enumerate(spans))).first()
        sketch = {span: got[f"s{i}"] for i, span in enumerate(spans)}
        for (c, k), v in open_.items():
            # A sketch's rank is off by one part in _SKETCH at most: a step of the grid to either side takes it in.
            at = (k - v[2]) / max(v[3] - 1, 1) * _GRID
            s = sketch[c, v[0], v[1]]
            v[0], v[1] = s[max(math.floor(at) - 1, 0)], s[min(math.ceil(at) + 1, _GRID)]
        counts = d.agg(*(f.alias(f"{m}{i}") for i, ((c, _), v) in enumerate(open_.items()) for m, f in (("b", F.count_if(F.col(c) < v[0])), ("n", F.count(between(c, v[0], v[1])))))).first()
        was = {k: tuple(v) for k, v in open_.items()}
        for i, v in enumerate(open_.values()):
            v[2], v[3] = counts[f"b{i}"], counts[f"n{i}"]
        if any(not v[2] <= k < v[2] + v[3] for (_, k), v in open_.items()):
            raise RuntimeError("a sketch missed a rank")
        if all(tuple(v) == was[k] for k, v in open_.items()):
            break  # few distinct values, each of many rows
    left = [(c, k, v) for (c, k), v in ranks.items() if v[0] < v[1]]
    if left:
        got = d.agg(*(F.percentile(between(c, v[0], v[1]), (k - v[2]) / max(v[3] - 1, 1)).alias(f"v{i}") for i, (c, k, v) in enumerate(left))).first()
        for i, (_, _, v) in enumerate(left):
            v[0] = got[f"v{i}"]
    out: dict[str, list[float] | None] = {}
    for c, (name, (_, ps)) in zip(d.columns, wanted.items()):
        out[name] = None
        if n[c]:
            at = [p * (n[c] - 1) for p in ps]
            a, b = ([ranks[c, f(k)][0] for k in at] for f in (math.floor, math.ceil))
            out[name] = [x + (y - x) * (k - math.floor(k)) for x, y, k in zip(a, b, at)]
    return out
