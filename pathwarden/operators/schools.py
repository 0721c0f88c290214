"""Schools, what lies around them, and places where accidents repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwarden.functions.semantics import to_double
from pathwarden.operators.spatial import clusters, met, nearest

# What a counted school has in the columns of the national list, and the names of its coordinates.
OPERATING = {"시도교육청명": "대전광역시교육청", "학교급구분": "초등학교", "운영상태": "운영"}
COORDINATES = ("위도", "경도")
# Flags of crossings and signals, and the shares made of them.
CROSSWALK_FLAGS = {
    "보행자신호등유무": "pedestrian_crosswalk_signal_ratio_300m", "음향신호기설치여부": "crosswalk_audio_ratio_300m", "점자블록유무": "tactile_block_ratio_300m",
    "고원식적용여부": "raised_crosswalk_ratio_300m", "집중조명시설유무": "focused_light_ratio_300m",
}
SIGNAL_FLAGS = {"보행자작동신호기유무": "actuated_signal_ratio_300m", "잔여시간표시기유무": "countdown_signal_ratio_300m", "시각장애인용음향신호기유무": "signal_audio_ratio_300m"}
LANES = {"차로수": "avg_lane_count_300m"}
RADII = (100, 300, 500)
#: Shares and means are taken over what lies within so many metres.
NEAR = 300


def operating(schools: DataFrame, wanted: dict[str, str] = OPERATING, coordinates: tuple[str, ...] = COORDINATES) -> DataFrame:
    """The schools that have all ``wanted`` values and no coordinate missing."""
    for column, value in wanted.items():
        schools = schools.where(F.col(column) == value)
    return schools.dropna(subset=list(coordinates))


def around(schools: DataFrame, layer: DataFrame, key: str, name: str, flags: dict[str, str], numbers: dict[str, str]) -> DataFrame:
    """Per school the objects of ``layer`` (lat, lon, flags, numbers) within each radius, shares of flags = Y and means of numbers; 0 where there are none.

    One join at the greatest radius and one aggregation, whatever the number of columns.
    """
    slim = layer.where("lat is not null and lon is not null").select("lat", "lon", *flags, *[to_double(c).alias(c) for c in numbers])
    pairs = met(schools.select(key, "lat", "lon"), slim, max(RADII))
    close = F.col("d") <= NEAR
    share = lambda c: F.try_divide(F.count_if(close & (F.upper(F.col(f"r_{c}").cast("string")) == "Y")), F.count_if(close))
    made = {f"{name}_count_{r}m": F.count_if(F.col("d") <= r) for r in RADII} | {out: share(c) for c, out in flags.items()} | {out: F.avg(F.when(close, F.col(f"r_{c}"))) for c, out in numbers.items()}
    found = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(*[c.alias(n) for n, c in made.items()])
    return schools.select(key).join(found, key, "left").na.fill(0, list(made))


def _district_counts(schools: DataFrame, counts: DataFrame | None, out: str) -> DataFrame:
    """``schools`` with the count of their district (district, count); 0 where it has none."""
    if counts is None:
        return schools.withColumn(out, F.lit(0).cast("long"))
    per = counts.groupBy("district").agg(F.max("count").cast("long").alias(out))
    return schools.join(per, "district", "left").na.fill(0, [out])


def risk_dataset(
    schools: DataFrame, crosswalks: DataFrame, signals: DataFrame, hotspots: DataFrame, key: str = "school_id", hotspot: str = "spot_id", label_radius: float = 300.0,
    academies: DataFrame | None = None, parking: DataFrame | None = None, crosswalk_flags: dict[str, str] = CROSSWALK_FLAGS, signal_flags: dict[str, str] = SIGNAL_FLAGS, lanes: dict[str, str] = LANES,
) -> DataFrame:
    """``schools`` (key, lat, lon, district, ...) with their surroundings and whether an accident place is within ``label_radius`` metres.

    Layers have an id (``crosswalk_id``, ``signal_id`` and ``hotspot``), lat and lon; hotspots also search_year and spot_nm.  Of places equally
    near, that with the smallest id counts.  Distances are null where a layer is empty.
    """
    points = schools.where("lat is not null and lon is not null")
    out = _district_counts(_district_counts(points, academies, "academy_count_district"), parking, "illegal_parking_count_district")
    for layer, name, flags, numbers in ((crosswalks, "crosswalk", crosswalk_flags, lanes), (signals, "signal", signal_flags, {})):
        near = nearest(points, layer.where("lat is not null and lon is not null"), key, f"{name}_id").select(key, F.col("distance").alias(f"nearest_{name}_m"))
        out = out.join(around(points, layer, key, name, flags, numbers), key).join(near, key, "left")
    spots = hotspots.where("lat is not null and lon is not null")
    hit = nearest(points, spots, key, hotspot).join(spots.select(hotspot, F.col("search_year").alias("nearest_hotspot_year"), F.col("spot_nm").alias("nearest_hotspot_name")), hotspot, "left")
    hit = hit.select(key, F.col("distance").alias("nearest_hotspot_m"), "nearest_hotspot_year", "nearest_hotspot_name")
    label = F.coalesce((F.col("nearest_hotspot_m") <= label_radius).cast("int"), F.lit(0))
    return out.join(hit, key, "left").withColumns({"accident_hotspot_within_radius": label, "label_radius_m": F.lit(float(label_radius))})


def district_distribution(df: DataFrame, label: str, group: str = "district") -> DataFrame:
    """Rows and positives of each district; rows without district are left out."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(label).alias("count"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("sum"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Years, records, accidents, casualties, deaths and centre of every cluster of accident places."""
    added: dict[str, Column] = {out: F.coalesce(F.sum(c), F.lit(0)) for c, out in (("occrrnc_cnt", "accident_count"), ("caslt_cnt", "casualty_count"), ("dth_dnv_cnt", "death_count"))}
    made = {"distinct_years": F.countDistinct("search_year"), "first_year": F.min("search_year"), "last_year": F.max("search_year"), "hotspot_records": F.count("*")} | added
    return clustered.groupBy("cluster").agg(*[c.alias(n) for n, c in made.items()], F.avg("lat").alias("latitude"), F.avg("lon").alias("longitude"))


def worst_cluster(summary: DataFrame) -> DataFrame:
    """The cluster with most deaths, then years, accidents and casualties; the smallest number on ties."""
    return summary.orderBy(F.desc("death_count"), F.desc("distinct_years"), F.desc("accident_count"), F.desc("casualty_count"), "cluster").limit(1)


def repeated_place(hotspots: DataFrame, schools: DataFrame, key: str = "spot_id", school: str = "school_id", radius: float = 400.0) -> DataFrame:
    """The accident places of the worst cluster, with its totals, its centre and the school nearest to that."""
    clustered = hotspots.join(clusters(hotspots, key, radius), key)
    worst = worst_cluster(cluster_summary(clustered))
    centre = worst.select("cluster", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = nearest(centre, schools, "cluster", school).select("cluster", F.col(school).alias("nearest_school"), F.round("distance", 1).alias("nearest_school_distance_m"))
    return clustered.join(F.broadcast(worst), "cluster").join(F.broadcast(near), "cluster", "left")


def route_endpoints(schools: DataFrame, academies: DataFrame, school: str, academy: str, cache: DataFrame, lookup=None, fallback: tuple[float, float] | None = None, query: str | None = None) -> DataFrame:
    """One row, the ends of a pilot route: ``school`` of ``schools`` (name, address, lat, lon) and ``academy`` of ``academies`` (name, address).

    The academy's place is that of ``query`` (its address, if none is given) by the geocoder and its ``cache``; where neither knows it, ``fallback``.  Of several rows
    of a name the first by address counts; without one of the two there is no row.
    """
    from pathwarden.sources.remote import geocode

    first = lambda df, name, cols: df.where(F.col("name") == name).groupBy("name").agg(F.min_by(F.struct(*cols), F.struct(*cols)).alias("f"))
    a = first(schools, school, ["address", "lat", "lon"]).select(F.col("name").alias("origin_name"), F.col("f.address").alias("origin_address"), F.col("f.lat").alias("origin_lat"), F.col("f.lon").alias("origin_lon"))
    b = first(academies, academy, ["address"]).select(F.col("name").alias("destination_name"), F.col("f.address").alias("destination_address"), (F.col("f.address") if query is None else F.lit(query)).alias("geocoded"))
    placed, _ = geocode(b, cache, lookup, "geocoded")
    lat, lon = fallback or (None, None)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ends = placed.select(
        "destination_name", "destination_address", F.col("geocoded").alias("destination_geocode_query"),
        *(F.when(known, F.col(c)).otherwise(F.lit(x).cast("double")).alias(f"destination_{c}") for c, x in (("lat", lat), ("lon", lon))),
    )
    return a.join(ends, F.lit(True))
