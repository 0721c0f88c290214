"""Scalars of road segments and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwarden.functions.semantics import clip

# Class of road, share of traffic, usual speed in km/h.
ROAD_CLASSES = [
    ("motorway", 1.00, 100.0), ("motorway_link", 0.95, 60.0), ("trunk", 0.95, 80.0), ("trunk_link", 0.90, 55.0),
    ("primary", 0.88, 60.0), ("primary_link", 0.84, 45.0), ("secondary", 0.76, 50.0), ("secondary_link", 0.72, 40.0),
    ("tertiary", 0.62, 40.0), ("tertiary_link", 0.58, 35.0), ("residential", 0.34, 30.0), ("unclassified", 0.30, 30.0),
    ("living_street", 0.18, 15.0), ("service", 0.16, 15.0), ("pedestrian", 0.08, 5.0), ("footway", 0.04, 5.0),
    ("path", 0.03, 5.0), ("steps", 0.01, 3.0), ("track", 0.08, 10.0),
]
OTHER_TRAFFIC, OTHER_SPEED = 0.25, 25.0
FOOT_ONLY = ["footway", "pedestrian", "path", "steps"]
ARTERIAL = [c for c, _, _ in ROAD_CLASSES[:10]]
DISTRICTS = ["동구", "중구", "서구", "유성구", "대덕구"]


def first_value(c: Column) -> Column:
    """The first of a list written as text, ``['a', 'b']``, or the text itself."""
    listed = F.from_json(F.translate(c, "'", '"'), "array<string>")
    return F.when(c.startswith("["), F.try_element_at(listed, F.lit(1))).otherwise(c)


def parse_number(c: Column, default: float) -> Column:
    """The first unsigned number in a text, else ``default``."""
    return F.coalesce(F.regexp_extract(first_value(c), r"\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(float(default)))


def highway_value(c: Column) -> Column:
    return F.lower(first_value(c))


def extract_district(c: Column, names: list[str] = DISTRICTS) -> Column:
    """The first district's name in an address, or null."""
    return F.nullif(F.regexp_extract(c, "(" + "|".join(names) + ")", 1), F.lit(""))


def segment_id(u: Column, v: Column, osmid: Column) -> Column:
    """The same for both directions; ids compare as text, and lists of ids are sorted."""
    u, v = u.cast("string"), v.cast("string")
    listed = F.array_join(F.array_sort(F.split(F.regexp_replace(osmid.cast("string"), r"[\[\]\s']", ""), ",")), "-")
    return F.concat_ws("-", F.lit("S"), F.least(u, v), F.greatest(u, v), listed)


def edge_id(u: Column, v: Column, key: Column) -> Column:
    return F.concat_ws("-", F.lit("E"), u.cast("string"), v.cast("string"), key.cast("string"))


def road_features(df: DataFrame) -> DataFrame:
    """``df`` (highway, maxspeed, lanes, sidewalk, incline, lit) with the proxies of a road."""
    dim = df.sparkSession.createDataFrame(ROAD_CLASSES, "_class string, _traffic double, _speed double")
    j = df.withColumn("_class", highway_value(F.coalesce("highway", F.lit("unclassified")))).join(F.broadcast(dim), "_class", "left")
    sidewalk, lit, h = F.lower("sidewalk"), F.lower("lit"), F.col("_class")
    narrow = (
        F.when(h.isin(FOOT_ONLY), 0.05).when(sidewalk.isin("both", "left", "right", "yes", "separate"), 0.20)
        .when(sidewalk.isin("no", "none"), 1.0).when(h.isin(ARTERIAL), 0.72).otherwise(0.55)
    )
    return j.withColumns({
        "traffic_volume_proxy": F.coalesce("_traffic", F.lit(OTHER_TRAFFIC)),
        "avg_speed_kph": F.coalesce(F.regexp_extract(first_value(F.col("maxspeed")), r"\d+(?:\.\d+)?", 0).try_cast("double"), F.col("_speed"), F.lit(OTHER_SPEED)),
        "lane_count": parse_number(F.col("lanes"), 1.0),
        "narrow_sidewalk_proxy": narrow,
        "slope_proxy": F.least(parse_number(F.col("incline"), 0.0) / 15.0, F.lit(1.0)),
        "is_alley": h.isin("service", "living_street").cast("double"),
        "lit_tag_score": F.when(lit.isin("yes", "24/7", "automatic"), 1.0).when(lit == "no", 0.0).otherwise(0.5),
    }).drop("_class", "_traffic", "_speed")


# Age group, weight of distance, greatest detour.
AGE_PROFILES = [("low", 0.20, 2.0), ("mid", 0.40, 1.6), ("high", 0.55, 1.4), ("middle", 0.70, 1.25)]


def age_profile(key: str) -> tuple[float, float]:
    """(weight of distance, greatest detour) of an age group."""
    for name, lam, detour in AGE_PROFILES:
        if name == key.lower().strip():
            return lam, detour
    raise ValueError(f"no age group {key!r}: one of {[p[0] for p in AGE_PROFILES]}")


def light_multiplier(hour: Column) -> Column:
    return F.when((hour < 6) | (hour >= 21), 1.8).otherwise(1.0)


def congestion_multiplier(hour: Column) -> Column:
    rush = ((hour >= 7) & (hour < 9)) | ((hour >= 16) & (hour < 19))
    return F.when((hour < 6) | (hour >= 21), 0.6).when(rush, 1.5).otherwise(1.0)


def time_label(hour: Column) -> Column:
    """Labels have other bounds than the multipliers: 6, 19 and 20 are night here and neutral there."""
    return F.when((hour >= 7) & (hour < 9), "to_school").when((hour >= 9) & (hour < 16), "day").when((hour >= 16) & (hour < 19), "from_school").otherwise("night")


def time_adjusted(score: Column, hour: Column, light: Column | None = None) -> Column:
    """A score adjusted for darkness and crowds, held within 0 and 1 after each step."""
    out = clip(score)
    if light is not None:
        out = clip(out + (light_multiplier(hour) - 1.0) * (1.0 - clip(light)) * 0.15)
    return clip(out + (congestion_multiplier(hour) - 1.0) * 0.05)


def detour(shortest: Column, candidate: Column, most: Column) -> tuple[Column, Column]:
    """(ratio rounded to 4 digits, whether the unrounded ratio is above ``most``)."""
    ratio = F.try_divide(candidate, shortest)
    none = shortest <= 0
    return F.when(none, 0.0).otherwise(F.bround(ratio, 4)), F.when(none, False).otherwise(ratio > most)
