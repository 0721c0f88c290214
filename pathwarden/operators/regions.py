"""Segments summed up by cell, district and class of road."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.adapters import HIGHWAYS
from pathwarden.functions.geo import cell
from pathwarden.functions.semantics import number
from pathwarden.operators.quality import keep_first, prepare_for_analysis
from pathwarden.storage import stored

UNASSIGNED = "미분류"
# The features of the regional model.
MEANS = [
    "length_m", "traffic_volume_norm", "avg_speed_norm", "narrow_sidewalk_norm", "slope_norm", "is_alley", "pedestrian_flow_norm", "academy_density_norm", "bus_stop_nearby_norm",
    "illegal_parking_norm", "light_density_norm", "has_crosswalk", "has_signal", "lane_count_norm", "has_speed_bump", "has_cctv", "is_school_zone",
    "crosswalk_count_norm", "signal_count_norm", "speed_bump_count_norm",
]
SPREADS = ["traffic_volume_norm", "avg_speed_norm", "narrow_sidewalk_norm", "slope_norm", "pedestrian_flow_norm", "bus_stop_nearby_norm", "illegal_parking_norm", "lane_count_norm"]
SUMS = ["length_m", "crosswalk_count", "signal_count", "speed_bump_count", "bus_stop_count", "streetlight_count", "school_zone_cctv_count", "is_school_zone", "has_crosswalk", "has_signal", "has_speed_bump", "has_cctv"]
PER_KM = {"crosswalk_count": "crosswalk_per_km", "signal_count": "signal_per_km", "speed_bump_count": "speed_bump_per_km", "bus_stop_count": "bus_stop_per_km", "streetlight_count": "streetlight_per_km", "school_zone_cctv_count": "school_zone_cctv_per_km"}
COVERAGE = {"is_school_zone": "school_zone_share", "has_crosswalk": "crosswalk_coverage", "has_signal": "signal_coverage", "has_speed_bump": "speed_bump_coverage", "has_cctv": "cctv_coverage"}
HAZARD_MEAN = {"traffic_volume_norm": 0.18, "avg_speed_norm": 0.12, "narrow_sidewalk_norm": 0.15, "slope_norm": 0.08, "pedestrian_flow_norm": 0.12, "illegal_parking_norm": 0.08, "lane_count_norm": 0.03}
HAZARD_LACKS = {"light_density_norm": 0.10, "has_crosswalk": 0.08, "has_signal": 0.06}
HAZARD_PEAK = {"traffic_volume_norm": 0.25, "avg_speed_norm": 0.15, "narrow_sidewalk_norm": 0.20, "pedestrian_flow_norm": 0.10, "illegal_parking_norm": 0.10, "lane_count_norm": 0.10}

MODEL_FEATURES = [
    *MEANS, "center_x", "center_y", "segment_count", *[f"{c}_{k}" for k in ("max", "std", "q90") for c in SPREADS], *[f"{c}_sum" for c in SUMS], *[f"hw_share_{h}" for h in HIGHWAYS],
    "log_segment_count", "road_length_km", *PER_KM.values(), *COVERAGE.values(), "structural_hazard_mean", "structural_hazard_peak",
]


def unique_segments(df: DataFrame) -> DataFrame:
    """One row a segment: the shortest edge, by edge_id when lengths tie."""
    return keep_first(df, ["segment_id"], *[c for c in ("length_m", "edge_id") if c in df.columns])


def with_region(df: DataFrame, cell_size: float = 1750.0) -> DataFrame:
    """``df`` with the keys of its segments' regions: district (never null), region_x and region_y."""
    return df.withColumns({"district": F.coalesce(F.col("district").cast("string"), F.lit(UNASSIGNED)), **{f"region_{a}": F.coalesce(cell(number(df, f"center_{a}"), cell_size), F.lit(0)) for a in "xy"}})


def region_features(df: DataFrame, cell_size: float = 1750.0) -> DataFrame:
    """All features of (district, region_x, region_y) in one aggregation, without a join; a segment that comes again counts once."""
    df = unique_segments(df) if "segment_id" in df.columns else df
    have = set(df.columns)
    value = lambda c: F.coalesce(number(df, c), F.lit(0.0)) if c in have else F.lit(1.0 if c == "length_m" else 0.0)
    names = list(dict.fromkeys(MEANS + SPREADS + SUMS))
    s = df.select(
        F.coalesce(F.col("district").cast("string"), F.lit(UNASSIGNED)).alias("district"),
        *[F.coalesce(cell(number(df, f"center_{a}"), cell_size), F.lit(0)).alias(f"region_{a}") for a in "xy"],
        number(df, "center_x").alias("center_x"), number(df, "center_y").alias("center_y"),
        F.when(F.col("highway").isin(HIGHWAYS[:-1]), F.col("highway")).otherwise("other").alias("_hw") if "highway" in have else F.lit("other").alias("_hw"),
        (F.coalesce(number(df, "accident_count"), F.lit(0.0)) > 0).cast("int").alias("accident_label"),
        *[value(c).alias(c) for c in names],
    )
    r = s.groupBy("district", "region_x", "region_y").agg(
        *[F.avg(c).alias(c) for c in MEANS], F.avg("center_x").alias("center_x"), F.avg("center_y").alias("center_y"), F.count("*").alias("segment_count"), F.max("accident_label").alias("accident_label"),
        *[F.max(c).alias(f"{c}_max") for c in SPREADS], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in SPREADS], *[F.percentile(c, 0.9).alias(f"{c}_q90") for c in SPREADS],
        *[F.sum(c).alias(f"{c}_sum") for c in SUMS], *[F.avg((F.col("_hw") == h).cast("double")).alias(f"hw_share_{h}") for h in HIGHWAYS],
    )
    km = F.greatest(F.col("length_m_sum") / 1000.0, F.lit(0.05))
    plus = lambda w, suffix="": sum((F.lit(x) * F.col(c + suffix) for c, x in w.items()), F.lit(0.0))
    lacks = sum((F.lit(x) * (1.0 - F.col(c)) for c, x in HAZARD_LACKS.items()), F.lit(0.0))
    return r.withColumns(
        {"log_segment_count": F.log1p("segment_count"), "road_length_km": F.col("length_m_sum") / 1000.0}
        | {out: F.col(f"{c}_sum") / km for c, out in PER_KM.items()}
        | {out: F.col(f"{c}_sum") / F.col("segment_count") for c, out in COVERAGE.items()}
        | {"structural_hazard_mean": plus(HAZARD_MEAN) + lacks, "structural_hazard_peak": plus(HAZARD_PEAK, "_max") + F.lit(0.10) * (1.0 - F.col("light_density_norm"))}
    )


def highway_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """The share of each road class in a group: fixed classes, so no pass to find them."""
    h = F.when(F.col("highway").isin(HIGHWAYS[:-1]), F.col("highway")).otherwise("other")
    return df.groupBy(*keys).agg(*[F.avg((h == c).cast("double")).alias(f"hw_share_{c}") for c in HIGHWAYS])


def count_pivot(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """A count column for each kind, 0 where there are none."""
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"{k}_count") for k in kinds])


def district_summary(df: DataFrame, final: str = "cmcs_final") -> DataFrame:
    """Per district: mean score, share of high risk and of accidents, coverage, comfort and size; null districts go, a segment that comes again counts once."""
    u = (unique_segments(df) if "segment_id" in df.columns else df).where("district is not null")
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    flags = sum((F.col(c).cast("double") for c in ("has_crosswalk", "has_signal", "has_speed_bump", "has_cctv")), F.lit(0.0)) / 4
    return u.groupBy("district").agg(
        F.avg(final).alias("average_cmcs"), F.avg((F.col(final) >= 0.6).cast("double")).alias("high_risk_ratio"), F.avg((F.col("accident_count") > 0).cast("double")).alias("accident_labeled_ratio"),
        F.avg(unit(flags)).alias("infrastructure_coverage"), F.avg(unit(1.0 - F.col("narrow_sidewalk_norm"))).alias("walking_comfort"), F.count("*").alias("segment_count"),
    )


def evidence_table(df: DataFrame, features: list[str], cell_size: float = 500.0) -> DataFrame:
    """The cells from which weights are learned, stored: mean features, centres, length, greatest accident count and label."""
    clean, _ = prepare_for_analysis(df)
    u = unique_segments(clean).withColumn("district", F.coalesce("district", F.lit(UNASSIGNED))).where("center_x is not null and center_y is not null")
    u = u.withColumns({"light_deficit": 1 - F.coalesce("light_density_norm", F.lit(0.5)), "crosswalk_deficit": 1 - F.col("has_crosswalk"), "signal_deficit": 1 - F.col("has_signal")})
    u = u.withColumns({"region_x": cell(F.col("center_x"), cell_size), "region_y": cell(F.col("center_y"), cell_size)})
    cells = u.groupBy("district", "region_x", "region_y").agg(
        *[F.avg(c).alias(c) for c in features], F.avg("center_x").alias("center_x"), F.avg("center_y").alias("center_y"), F.count("*").alias("segment_count"),
        F.sum("length_m").alias("length_m"), F.max("accident_count").alias("accident_count"), F.max((F.col("accident_count") > 0).cast("int")).alias("accident_label"),
    )
    return stored(cells)[0]
