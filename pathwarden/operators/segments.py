"""Raw counts and proxies of road segments as the score's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.functions.semantics import bounded, clip, log_value, minmax_of, number

# Counts scaled by the logarithm between their bounds, and the names of the results.
SCALED = {
    "academy_density": "academy_density_norm", "illegal_parking": "illegal_parking_norm", "bus_stop_count": "bus_stop_nearby_norm", "crosswalk_count": "crosswalk_count_norm",
    "signal_count": "signal_count_norm", "speed_bump_count": "speed_bump_count_norm", "accident_count": "accident_count_norm", "streetlight_count": "_light",
}
# Counts of which any makes a flag.
FLAGS = {"crosswalk_count": "has_crosswalk", "signal_count": "has_signal", "speed_bump_count": "has_speed_bump", "school_zone_cctv_count": "has_cctv"}


def normalised(df: DataFrame) -> DataFrame:
    """``df`` with flags and with all inputs of the score between 0 and 1.

    The bounds of all counts come from one aggregation.  A null count is 0; a null proxy, speed, number of lanes, light tag or school zone gives null.
    """
    logs = {c: log_value(number(df, c), True) for c in SCALED}
    r = df.agg(*[f(x).alias(f"{n}_{c}") for c, x in logs.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {out: minmax_of(logs[c], F.lit(r[f"lo_{c}"]), F.lit(r[f"hi_{c}"])) if r[f"lo_{c}"] is not None else F.lit(0.0) for c, out in SCALED.items()}
    simple = {
        "traffic_volume_norm": clip(number(df, "traffic_volume_proxy")),
        "avg_speed_norm": clip(number(df, "avg_speed_kph") / 100.0),
        "narrow_sidewalk_norm": clip(number(df, "narrow_sidewalk_proxy")),
        "slope_norm": clip(number(df, "slope_proxy")),
        "lane_count_norm": clip(number(df, "lane_count"), 1.0, 6.0) / 6.0,
    }
    flags = {out: F.coalesce((number(df, c) > 0).cast("int"), F.lit(0)) for c, out in FLAGS.items()}
    out = df.withColumns(scaled | simple | flags)
    flow = 0.45 * F.col("academy_density_norm") + 0.35 * F.col("bus_stop_nearby_norm") + 0.20 * number(df, "is_school_zone")
    lit = number(df, "lit_tag_score")
    return out.withColumns({"light_density_norm": F.when(lit.isNotNull(), F.greatest(lit, F.col("_light"))), "pedestrian_flow_norm": F.when(flow.isNotNull(), bounded(flow))}).drop("_light")


def segment_counts(edges: DataFrame, score: str = "cmcs_final", high: float = 0.6) -> DataFrame:
    """Directed edges, distinct segments, the mean score and how many edges score ``high`` or more, as one row."""
    return edges.agg(F.count("*").alias("directed_edges"), F.countDistinct("segment_id").alias("unique_segments"), F.avg(score).alias("mean"), F.count_if(F.col(score) >= high).alias("high_risk_edge_count"))
