"""Joins by distance: grid buckets first, distances for what shares a bucket."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.functions.geo import cell, haversine, in_polygon, polyline_distance2, segment_distance2
from pathwarden.operators.ordering import numbered
from pathwarden.storage import discard, stored

_METRES_PER_DEGREE = math.pi * 6_371_000.0 / 180
_HALF_WAY = 20_100_000.0


def _around(c: Column, reach: int = 1) -> Column:
    return F.explode(F.sequence(c - reach, c + reach))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_xy=("x", "y"), right_xy=("x", "y")) -> DataFrame:
    """Pairs within ``radius`` in the plane, inclusive, with squared distance ``d2``.

    Columns are prefixed ``l_`` and ``r_``.  The right side is dealt to the nine cells around it, so
    each pair meets in exactly one cell; the size of a cell is the radius.
    """
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumns({"_cx": cell(F.col(f"l_{left_xy[0]}"), radius), "_cy": cell(F.col(f"l_{left_xy[1]}"), radius)})  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("_cx", _around(cell(F.col(f"r_{right_xy[0]}"), radius))).withColumn("_cy", _around(cell(F.col(f"r_{right_xy[1]}"), radius)))
    dx, dy = F.col(f"l_{left_xy[0]}") - F.col(f"r_{right_xy[0]}"), F.col(f"l_{left_xy[1]}") - F.col(f"r_{right_xy[1]}")
    return l.join(r, ["_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).drop("_cx", "_cy")


def earth_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (lat, lon in degrees) within ``radius`` metres along the sphere, with distance ``d``.

    Bands of latitude are as high as the radius; cells of longitude are as wide as the radius at the
    latitude of the band's far edge, so neighbours suffice.  Points near the 180th meridian are dealt to both ends of their band.
    """
    step = radius / _METRES_PER_DEGREE * (1 + 1e-9)
    band = lambda lat: F.floor(lat / step).cast("long")
    # Each band has its own width of cell, taken at its edge farthest from the equator, one band further out.
    width = lambda b: step / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs((b - 1) * step), F.abs((b + 2) * step)), F.lit(89.9)))), F.lit(1e-3))
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_b", band(F.col("l_lat")))  # noqa: E741
    l = l.withColumn("_c", F.floor(F.col("l_lon") / width(F.col("_b"))).cast("long"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_b", _around(band(F.col("r_lat"))))
    wide, none = width(F.col("_b")), F.array().cast("array<bigint>")
    at = lambda lon: F.floor(lon / wide).cast("long")
    near = lambda lon: F.sequence(at(lon) - 1, at(lon) + 1)
    lon = F.col("r_lon")
    # A cell is named once, so a pair meets once however wide the cells are.
    cells = F.array_distinct(F.concat(near(lon), F.when(lon >= 180 - wide, near(lon - 360)).otherwise(none), F.when(lon <= -180 + wide, near(lon + 360)).otherwise(none)))
    r = r.withColumn("_c", F.explode(cells))
    return l.join(r, ["_b", "_c"]).withColumn("d", haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("d") <= radius).drop("_b", "_c")


def met(origins: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """:func:`earth_pairs`, with the side of fewer rows dealt to the cells around it: the other one moves once."""
    if origins.count() > targets.count():
        return earth_pairs(origins, targets, radius)
    pairs, other = earth_pairs(targets, origins, radius), {"l_": "r_", "r_": "l_"}
    return pairs.toDF(*(other.get(c[:2], c[:2]) + c[2:] for c in pairs.columns))


def _per_square_metre(points: DataFrame) -> float:
    """How dense points are in their box, roughly."""
    r = points.agg(F.count("lat").alias("n"), *(f(c).alias(f"{n}{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not r["n"] or r["lolon"] is None:
        return 0.0
    wide = (r["hilon"] - r["lolon"]) * math.cos(math.radians((r["hilat"] + r["lolat"]) / 2))
    return r["n"] / max((r["hilat"] - r["lolat"]) * abs(wide) * _METRES_PER_DEGREE**2, 1.0)


def radius_counts(origins: DataFrame, targets: DataFrame, key: str, radii: list[int]) -> DataFrame:
    """Targets within each radius of every origin: one join at the greatest radius, one aggregation."""
    pairs = met(origins, targets, max(radii))
    counted = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(*[F.count_if(F.col("d") <= r).alias(f"within_{r}") for r in radii])
    return origins.select(key).join(counted, key, "left").na.fill(0, [f"within_{r}" for r in radii])


def nearby_stats(origins: DataFrame, targets: DataFrame, key: str, flag: str, number: str, radius: float) -> DataFrame:
    """The share of ``flag`` = Y and the mean of ``number`` within a radius; 0 where there is none."""
    pairs = met(origins, targets, radius)
    x = F.col(f"r_{number}")
    got = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(
        F.try_divide(F.count_if(F.upper(F.col(f"r_{flag}")) == "Y"), F.count("*")).alias("ratio"), F.avg(F.when(~F.isnan(x), x)).alias("mean"))
    return origins.select(key).join(got, key, "left").na.fill(0.0, ["ratio", "mean"])


def nearest(origins: DataFrame, targets: DataFrame, key: str, target: str, start_radius: float = 500.0) -> DataFrame:
    """The nearest target of every origin and its distance, the smallest ``target`` on ties.

    Searches within a radius that grows fourfold for the origins still without a hit, so dense
    places cost little and lonely ones are found all the same; the last radius is half the way round the earth.  The first is ``start_radius``,
    or less where targets lie so close that some ten are within less.  Every round is stored.
    """
    left, out, spark = origins.select(key, "lat", "lon"), None, origins.sparkSession
    targets = targets.select(target, "lat", "lon")
    if targets.limit(1).count() == 0:
        return origins.select(key, F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(None).cast("double").alias("distance"))
    dense = _per_square_metre(targets)
    radius = max(1.0, min(start_radius, math.sqrt(10 / (math.pi * dense)))) if dense > 0 else start_radius
    while True:
        last = radius >= _HALF_WAY
        pairs = met(left, targets, radius)
        hit = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min_by(F.struct(F.col(f"r_{target}").alias("t"), "d"), F.struct("d", f"r_{target}")).alias("m")).select(key, F.col("m.t").alias(target), F.col("m.d").alias("distance"))
        hit, _ = stored(hit)
        out = hit if out is None else out.unionByName(hit)
        rest, at = stored(left.join(hit, key, "left_anti"))
        if last or rest.limit(1).count() == 0:
            discard(spark, at)
            return out
        left, radius = rest, min(radius * 4, _HALF_WAY)


def knn(points: DataFrame, key: str, k: int = 8, cell_size: float | None = None) -> DataFrame:
    """(key, neighbour, d2, n): the ``k`` nearest others in the plane; ties by neighbour.

    Rings of cells are widened for the points whose k-th neighbour may lie beyond what was searched.
    """
    r = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not r["n"]:
        return points.select(F.col(key), F.col(key).alias("neighbour"), F.lit(0.0).alias("d2"), F.lit(0).alias("n"))
    wide, high = r["hix"] - r["lox"], r["hiy"] - r["loy"]
    # Points on a line have no area: then cells are as long as they would be along it.
    size = cell_size or max(math.sqrt(wide * high * (k + 1) / r["n"]), max(wide, high) * (k + 1) / r["n"], 1e-9)
    span = max(wide, high) / size + 2
    open_, out, reach = points.select(key, "x", "y"), None, 1
    right = points.select(F.col(key).alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny")).withColumns({"_cx": cell(F.col("nx"), size), "_cy": cell(F.col("ny"), size)})
    while True:
        left = open_.withColumn("_cx", _around(cell(F.col("x"), size), reach)).withColumn("_cy", _around(cell(F.col("y"), size), reach))
        pairs = left.join(right, ["_cx", "_cy"]).where(F.col(key) != F.col("neighbour")).withColumn("d2", F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
        ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("d2", "neighbour"))).where(F.col("n") <= k)
        whole = reach >= span
        sure = ranked.withColumn("_far", F.max(F.when(F.col("n") == k, F.col("d2"))).over(Window.partitionBy(key)))
        done = sure if whole else sure.where(F.col("_far") <= F.lit((reach * size) ** 2))
        done = done.select(key, "neighbour", "d2", "n")
        out = done if out is None else out.unionByName(done)
        if whole:
            return out
        rest = open_.join(done.select(key).distinct(), key, "left_anti")
        if rest.limit(1).count() == 0:
            return out
        open_, reach = rest, min(reach * 4, math.ceil(span))


def nearest_edge(points: DataFrame, edges: DataFrame, point: str, edge: str, reach: float = 500.0) -> DataFrame:
    """The nearest polyline of every point; the smallest edge on ties.  No rows without edges.

    Edges are dealt to all cells that their box, widened by ``reach``, touches; for points without an edge in reach it grows fourfold, up
    to the extent of everything.  Edges without a line, and lines and points without a coordinate, play no part.
    """
    box = lambda f, a: f(F.transform("line", lambda p: p[a]))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    edges = edges.where((F.size("line") > 0) & F.forall("line", lambda p: known(p["x"]) & known(p["y"])))
    left, out = points.where(known(F.col("x")) & known(F.col("y"))), None
    ends = [edges.agg(*(g(box(f, a)).alias(f"{n}{a}") for a in "xy" for n, f, g in (("lo", F.array_min, F.min), ("hi", F.array_max, F.max)))).first(),
            left.agg(*(g(a).alias(f"{n}{a}") for a in "xy" for n, g in (("lo", F.min), ("hi", F.max)))).first()]
    if any(e["lox"] is None for e in ends):
        return points.select(point, F.lit(None).cast(edges.schema[edge].dataType).alias(edge), F.lit(None).cast("double").alias("distance")).limit(0)
    extent = sum(max(e[f"hi{a}"] for e in ends) - min(e[f"lo{a}"] for e in ends) for a in "xy")
    while True:
        e = edges
        for a in "xy":
            e = e.withColumn(f"_c{a}", F.explode(F.sequence(cell(box(F.array_min, a) - reach, reach), cell(box(F.array_max, a) + reach, reach))))
        p = left.withColumns({"_cx": cell(F.col("x"), reach), "_cy": cell(F.col("y"), reach)})
        pairs = p.join(e.select(edge, "line", "_cx", "_cy"), ["_cx", "_cy"]).withColumn("d2", polyline_distance2(F.col("x"), F.col("y"), F.col("line"))).where(F.col("d2") <= reach * reach)
        hit = pairs.groupBy(point).agg(F.min_by(F.struct(F.col(edge).alias("e"), "d2"), F.struct("d2", edge)).alias("m")).select(point, F.col("m.e").alias(edge), F.sqrt("m.d2").alias("distance"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit, point, "left_anti")
        if reach > extent or left.limit(1).count() == 0:
            return out
        reach *= 4


def _crossed(ax: Column, ay: Column, bx: Column, by: Column, size: float, df: DataFrame) -> DataFrame:
    """``df`` with a row for each cell (``_cx``, ``_cy``) that a segment passes: column by column, what it covers there."""
    lo, hi = F.least(ax, bx), F.greatest(ax, bx)
    d = df.withColumn("_cx", F.explode(F.sequence(cell(lo, size), cell(hi, size))))
    at = lambda x: F.when(bx == ax, None).otherwise(ay + (by - ay) * (F.least(F.greatest(x, lo), hi) - ax) / F.nullif(bx - ax, F.lit(0.0)))
    left, right = F.coalesce(at(F.col("_cx") * size), ay), F.coalesce(at((F.col("_cx") + 1) * size), by)
    # The shift takes in the neighbour where rounding could decide.
    return d.withColumn("_cy", F.explode(F.sequence(cell(F.least(left, right) - size * 1e-6, size), cell(F.greatest(left, right) + size * 1e-6, size))))


def _sides(lines: DataFrame, key: str, line: str, closed: bool) -> DataFrame:
    """(key, _ax, _ay, _bx, _by) of a polyline's segments; a ring's last point meets its first.  A point alone is a segment of no length."""
    n = F.size(line)
    nxt = lambda i: F.element_at(line, F.when(i < n, i + 1).otherwise(F.lit(1) if closed else n))
    last = n if closed else F.greatest(n - 1, F.lit(1))
    one = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(*(F.element_at(line, i)[a].alias(f"_a{a}") for a in "xy"), *(nxt(i)[a].alias(f"_b{a}") for a in "xy")))
    known = F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return lines.where((n > 0) & known).select(key, F.explode(one).alias("s")).select(key, "s.*")


_ENDS = [f"_{e}{a}" for e in "ab" for a in "xy"]


def within(points: DataFrame, polygons: DataFrame, point: str, name: str, cell_size: float | None = None) -> DataFrame:
    """The first polygon (by name) that holds each point, else the nearest by outline; null without polygons.

    Polygons are cut into cells (some 256 each, by their boxes' area together): a point in an interior cell is inside, one in a cell that the outline passes is
    tested, and what is left over takes the nearest outline.  Points without a coordinate get null.
    """
    rings = polygons.where(F.size("ring") > 0).select(name, "ring")
    box = lambda f, a: f(F.transform("ring", lambda p: p[a]))
    boxes = rings.select(name, "ring", *(box(f, a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))))
    r = boxes.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("hix") - F.col("lox")) * (F.col("hiy") - F.col("loy"))).alias("area"), F.max(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))).alias("wide")).first()
    if not r["n"]:
        return points.withColumn(name, F.lit(None).cast(polygons.schema[name].dataType))
    size = cell_size or max(math.sqrt((r["area"] or 0.0) / (256 * r["n"])), (r["wide"] or 0.0) / 4096, 1e-9)
    sides = _sides(rings, name, "ring", True)
    border = _crossed(*(F.col(c) for c in _ENDS), size, sides).select(name, "_cx", "_cy").distinct().withColumn("_border", F.lit(True))
    cells = boxes.withColumn("_cx", F.explode(F.sequence(cell(F.col("lox"), size), cell(F.col("hix"), size)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("loy"), size), cell(F.col("hiy"), size))))
    inner = cells.join(border, [name, "_cx", "_cy"], "left_anti").where(in_polygon((F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size, F.col("ring")))
    cover = border.unionByName(inner.select(name, "_cx", "_cy", F.lit(False).alias("_border")))
    met = points.select(point, "x", "y", cell(F.col("x"), size).alias("_cx"), cell(F.col("y"), size).alias("_cy")).join(cover, ["_cx", "_cy"])
    tested = met.where("_border").join(rings, name).where(in_polygon(F.col("x"), F.col("y"), F.col("ring")))
    hit = met.where("not _border").select(point, name).unionByName(tested.select(point, name)).groupBy(point).agg(F.min(name).alias(name))
    rest = points.select(point, "x", "y").join(hit, point, "left_anti")
    lines = sides.select(name, F.array(*(F.struct(F.col(f"_{e}x").alias("x"), F.col(f"_{e}y").alias("y")) for e in "ab")).alias("line"))
    near = nearest_edge(rest, lines, point, name, reach=8 * size).select(point, name)
    return points.join(hit.unionByName(near), point, "left")


def band_pairs(points: DataFrame, key: str, lo: float = 700.0, hi: float = 3000.0, want: float = 1600.0) -> DataFrame:
    """For each point the other at lo..hi metres whose distance is nearest ``want``; each unordered pair once.

    Looks in a ring around ``want``, at first so narrow that some ten others are in it, and four times as wide for the points still without one.
    """
    slim, best = points.select(key, "lat", "lon"), None
    left, most, dense = slim, max(want - lo, hi - want, 0.0), _per_square_metre(slim)
    half = min(most, max(1.0, 10 / (4 * math.pi * max(want, 1.0) * dense))) if dense > 0 else most
    while True:
        reach = hi if half >= most else min(hi, (want + half) * (1 + 1e-9))
        pairs = earth_pairs(slim, left, reach).where((F.col("d") >= lo) & (F.col(f"l_{key}") != F.col(f"r_{key}")))
        pairs = pairs if half >= most else pairs.where(F.abs(F.col("d") - want) <= half)
        hit, _ = stored(pairs.groupBy(F.col(f"r_{key}").alias("o")).agg(F.min_by(F.struct(F.col(f"l_{key}").alias("t"), "d"), F.struct(F.abs(F.col("d") - want), F.col(f"l_{key}"))).alias("m")))
        best = hit if best is None else best.unionByName(hit)
        if half >= most:
            break
        left, _ = stored(left.join(hit, left[key] == hit["o"], "left_anti"))
        if left.limit(1).count() == 0:
            break
        half = min(half * 4, most)
    return best.select(F.least("o", "m.t").alias("origin"), F.greatest("o", "m.t").alias("destination"), F.col("m.d").alias("distance")).groupBy("origin", "destination").agg(F.min("distance").alias("distance"))


def district_pairs(points: DataFrame, key: str, name: str, district: str, count: int = 25, lo: float = 700.0, hi: float = 3000.0, want: float = 1600.0) -> DataFrame:
    """(origin, destination, distance, district): some evenly spread points of each district by name, each with the point at lo..hi metres whose distance is nearest ``want``.

    Every district gives ceil(count / districts) origins at most; an unordered pair counts once, for the district that names it first; ties go to the smaller key.  Points without a district are
    destinations only.
    """
    sizes = points.where(F.col(district).isNotNull()).groupBy(district).agg(F.count(F.lit(1)).alias("_n"))
    each = max(1, math.ceil(count / max(sizes.count(), 1)))
    placed = numbered(points.where(F.col(district).isNotNull()), [name, key], "_i", by=[district], per_group=sizes)
    k = F.least(F.lit(each), F.col("_n"))
    spots = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, F.floor(i * (F.col("_n") - 1) / F.nullif(k - 1, F.lit(0)))).otherwise(0))
    chosen = placed.where(F.array_contains(spots, F.col("_i")))
    pairs = earth_pairs(chosen.select(key, "lat", "lon", district, name), points.select(key, "lat", "lon"), hi).where((F.col("d") >= lo) & (F.col(f"l_{key}") != F.col(f"r_{key}")))
    at = F.struct(F.col(f"l_{district}").alias("district"), F.col(f"l_{name}").alias("name"), F.col(f"l_{key}").alias("origin"))
    best = pairs.groupBy(at.alias("at")).agg(F.min_by(F.struct(F.col(f"r_{key}").alias("t"), "d"), F.struct(F.abs(F.col("d") - want), F.col(f"r_{key}"))).alias("m"))
    once = best.groupBy(F.least("at.origin", "m.t").alias("_a"), F.greatest("at.origin", "m.t").alias("_b")).agg(F.min(F.struct("at", "m")).alias("x"))
    return once.select(F.col("x.at.origin").alias("origin"), F.col("x.m.t").alias("destination"), F.col("x.m.d").alias("distance"), F.col("x.at.district").alias("district"))


def clusters(points: DataFrame, key: str, radius: float = 400.0) -> DataFrame:
    """(key, cluster): points chained by steps of at most ``radius`` metres; the cluster is its smallest key.

    Points of a cell whose diagonal is shorter than the radius are chained anyway.  Cells are chained by their outermost points first; point by point
    goes only what lies in cells that have one of another cluster near.  Points without a place on the globe are alone.
    """
    spark, step = points.sparkSession, 0.9 * radius / _METRES_PER_DEGREE / math.sqrt(2)
    # A cell is as wide as the radius allows at its band's edge nearest the equator.
    nearest_edge = F.when(F.col("_gb") >= 0, F.col("_gb")).otherwise(-F.col("_gb") - 1) * step
    wide = step / F.greatest(F.cos(F.radians(nearest_edge)), F.lit(1e-3))
    known = F.col("lat").between(-90, 90) & F.col("lon").isNotNull() & ~F.isnan("lon")
    banded = points.where(known).select(key, "lat", "lon").withColumn("_gb", F.floor(F.col("lat") / step).cast("long"))
    placed, own_at = stored(banded.withColumn("_gc", F.floor(F.col("lon") / wide).cast("long")))
    ends = [f(F.struct(*by)).alias(f"_e{i}") for i, (f, by) in enumerate((f, by) for f in (F.min, F.max) for by in (("lat", "lon"), ("lon", "lat")))]
    cells, cells_at = stored(placed.groupBy("_gb", "_gc").agg(F.min(key).alias("_rep"), *ends))
    place = lambda e: F.struct(e["lat"].alias("lat"), e["lon"].alias("lon"))
    outer = cells.select("_rep", F.explode(F.array_distinct(F.array(*(place(F.col(f"_e{i}")) for i in range(4))))).alias("e")).select("_rep", "e.*")
    pair = lambda df, a, b: df.where(F.col(a) < F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    # A key that comes again chains its places.
    again = placed.join(cells.select("_gb", "_gc", "_rep"), ["_gb", "_gc"]).groupBy(key).agg(F.min("_rep").alias("_lo"), F.collect_set("_rep").alias("_reps")).where(F.size("_reps") > 1)
    links = pair(earth_pairs(outer, outer, radius), "l__rep", "r__rep").unionByName(pair(again.select("_lo", F.explode("_reps").alias("_rep")), "_lo", "_rep"))
    chained = cells.join(least_labels(links).withColumnRenamed("node", "_rep"), "_rep", "left").select("_gb", "_gc", "_rep", F.coalesce("label", "_rep").alias("_label"), "_e0.lat", "_e0.lon")
    chained, chained_at = stored(chained)
    one = chained.select("_rep", "_label", "lat", "lon")
    # Points within the radius of each other are in cells whose first points are within it and two diagonals.
    open_ = earth_pairs(one, one, 2.8 * radius).where("l__label <> r__label").select(F.col("l__rep").alias("_rep")).distinct()
    rest = placed.join(chained.join(open_, "_rep", "left_semi").select("_gb", "_gc", "_label"), ["_gb", "_gc"]).select("_label", "lat", "lon")
    more = least_labels(pair(earth_pairs(rest, rest, radius), "l__label", "r__label")).select(F.col("node").alias("_label"), "label")
    final = chained.join(more, "_label", "left").select("_gb", "_gc", F.coalesce("label", "_label").alias("cluster"))
    labels, _ = stored(placed.join(final, ["_gb", "_gc"]).groupBy(key).agg(F.min("cluster").alias("cluster")))
    discard(spark, own_at, cells_at, chained_at)
    return points.select(key).join(labels, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; every round is stored, so that neither lineage nor plan grows."""
    spark = edges.sparkSession
    both, both_at = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump, then_at = stored(low.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        discard(spark, at)
        labels, at = jump.select("node", "label"), then_at
        if not jump.where("was <> label").limit(1).count():
            discard(spark, both_at)
            return labels


def route_buffer(edges: DataFrame, route: DataFrame, edge: str, reach: float = 700.0) -> DataFrame:
    """``edges`` (``edge``, ``line``) that come within ``reach`` of a route's polylines (``line``), between vertices too; all edges where the route has no line.

    Both are dealt segment by segment to the cells that they pass, the route's to their neighbours as well, and compared where they meet.
    """
    keyed = route.select(F.lit(0).alias("_route"), "line")
    mine = _sides(keyed, "_route", "line", False)
    if mine.limit(1).count() == 0:
        return edges
    theirs = _crossed(*(F.col(c) for c in _ENDS), reach, _sides(edges, edge, "line", False))
    around = _crossed(*(F.col(c) for c in _ENDS), reach, mine).withColumns({c: _around(F.col(c)) for c in ["_cx"]}).withColumns({c: _around(F.col(c)) for c in ["_cy"]})
    r = around.select("_cx", "_cy", *(F.col(c).alias(f"_r{c}") for c in _ENDS)).distinct()
    near = theirs.join(r, ["_cx", "_cy"]).where(segment_distance2(*(F.col(c) for c in _ENDS), *(F.col(f"_r{c}") for c in _ENDS)) <= reach * reach)
    return edges.join(near.select(edge).distinct(), edge, "left_semi")
