"""Statistical evidence for the weights of the score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.operators.ordering import running
from pathwarden.operators.scoring import Weights
from pathwarden.operators.spatial import knn
from pathwarden.storage import stored

# Feature, dimension, expected sign.
SPECS = [
    ("traffic_volume_norm", "risk", 1), ("avg_speed_norm", "risk", 1), ("narrow_sidewalk_norm", "discomfort", 1), ("slope_norm", "discomfort", 1), ("is_alley", "discomfort", 1),
    ("pedestrian_flow_norm", "congestion", 1), ("academy_density_norm", "congestion", 1), ("bus_stop_nearby_norm", "congestion", 1), ("illegal_parking_norm", "obstruction", 1),
    ("light_deficit", "obstruction", 1), ("crosswalk_deficit", "crossing", 1), ("signal_deficit", "crossing", 1), ("lane_count_norm", "crossing", 1),
    ("has_speed_bump", "safety_bonus", -1), ("has_cctv", "safety_bonus", -1), ("is_school_zone", "safety_bonus", -1),
]
FEATURES = [f for f, _, _ in SPECS]
BONUS_CAP = 0.15


def specs(spark) -> DataFrame:
    return spark.createDataFrame(SPECS, "feature string, dimension string, expected_sign int")


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """A row per row of ``df`` and feature (feature, x)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_p")
    d = df.select(*keep, pairs)
    return d.select(*[c for c in d.columns if c != "_p"], "_p.feature", "_p.x")


def spearman(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, rho): rank correlation with average ranks of all features in one pass; 0 where either is constant."""
    d = long_form(df, features, F.col(target).cast("double").alias("y")).where("x is not null and y is not null")
    # Ranks come from counts of distinct values, so equal values don't meet in one window.
    rank = lambda v, out: (
        running(d.groupBy("feature", v).count(), [v], {"_c": "count"}, by=["feature"]).select("feature", F.col(v).alias(f"_{v}"), (F.col("_c") - (F.col("count") - 1) / 2.0).alias(out))
    )
    pairs = d.groupBy("feature", "x", "y").count()
    rx, ry = rank("x", "rx"), rank("y", "ry")
    j = pairs.join(rx.withColumnRenamed("_x", "x"), ["feature", "x"]).join(ry.withColumnRenamed("_y", "y"), ["feature", "y"])
    n = F.col("count")
    s = j.groupBy("feature").agg(F.sum("count").alias("n"), F.sum(n * F.col("rx")).alias("sx"), F.sum(n * F.col("ry")).alias("sy"), F.sum(n * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(n * F.col("ry") * F.col("ry")).alias("syy"))
    cov, vx, vy = (F.col("n") * F.col(a) - F.col(b) * F.col(c) for a, b, c in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    return s.select("feature", "n", F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))), F.lit(0.0)).alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(rho: float, n: int) -> float:
    """The p-value of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    return beta_cdf(df / 2, 0.5, 1 - rho * rho) if rho else 1.0


def spearman_evidence(df: DataFrame, target: str = "accident_count", features: list[str] = FEATURES) -> DataFrame:
    """(feature, rho, p_value, score); one row a feature, so the p-value's function sees a handful of rows."""
    rho = spearman(df, features, target)

    def p(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p_value=[t_two_sided(r, int(n)) for r, n in zip(f["rho"], f["n"])])

    out = rho.join(F.broadcast(specs(df.sparkSession)), "feature").mapInPandas(p, "feature string, n long, rho double, dimension string, expected_sign int, p_value double")
    strength = F.greatest(F.col("expected_sign") * F.col("rho"), F.lit(0.0)) * F.greatest(1 - F.col("p_value") / 0.10, F.lit(0.0))
    return out.select("feature", "rho", "p_value", strength.alias("score"))


def bivariate_moran(df: DataFrame, key: str, features: list[str], target: str, k: int = 8, neighbours: DataFrame | None = None) -> DataFrame:
    """(feature, moran): sum of z(x) times the mean z(y) of the k nearest cells over the sum of z(x) squared; 0 for constants."""
    near = knn(df.select(key, F.col("center_x").alias("x"), F.col("center_y").alias("y")), key, k) if neighbours is None else neighbours
    y = F.col(target).cast("double")
    stats = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    lag = near.join(df.select(F.col(key).alias("neighbour"), y.alias("_y")), "neighbour").groupBy(key).agg(F.avg("_y").alias("_lag"))
    d = long_form(df.join(lag, key), features, key, "_lag")
    m = d.groupBy("feature").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.sum(F.col("x") * (F.col("_lag") - F.lit(stats["m"]))).alias("xl"), F.sum(F.col("_lag") - F.lit(stats["m"])).alias("l"), F.count("x").alias("n"))
    value = F.try_divide(F.col("xl") - F.col("mx") * F.col("l"), F.col("n") * F.col("sx") * F.lit(stats["s"]))
    flat = (F.abs(F.col("sx")) <= 1e-8) | F.lit(stats["s"] is None or abs(stats["s"]) <= 1e-8)
    return m.select("feature", F.when(flat, 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("moran"))


def moran_permutation(df: DataFrame, key: str, features: list[str], target: str, k: int = 8, permutations: int = 499, seed: int = 42) -> DataFrame:
    """(feature, moran, p_value, score) with one random stream over the features in their order.

    The stream is one by definition, so one task runs it; cells are a few thousand. Rows are taken by key.
    """
    near = knn(df.select(key, F.col("center_x").alias("x"), F.col("center_y").alias("y")), key, k)
    lists = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "neighbour"))).alias("near"))
    table = df.join(lists, key).select(key, target, *features, F.col("near.neighbour").alias("near"))
    signs = {f: s for f, _, s in SPECS}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key).reset_index(drop=True)
        at = {v: i for i, v in enumerate(f[key])}
        ids = np.array([[at[x] for x in row] for row in f["near"]])
        y = f[target].to_numpy(float)
        rng = np.random.default_rng(seed)
        z = lambda v: (v - v.mean()) / v.std() if v.std() > 1e-8 else None

        def moran(x, v):
            a, b = z(x), z(v)
            return 0.0 if a is None or b is None else float(a @ b[ids].mean(axis=1) / (a @ a))

        out = []
        for name in features:
            x = f[name].to_numpy(float)
            seen = moran(x, y)
            more = np.array([moran(x, rng.permutation(y)) for _ in range(permutations)])
            p = float((1 + (np.abs(more) >= abs(seen)).sum()) / (permutations + 1))
            out.append((name, seen, p, max(0.0, signs.get(name, 1) * seen) * (1 - p)))
        return pd.DataFrame(out, columns=["feature", "moran", "p_value", "score"])

    return table.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "feature string, moran double, p_value double, score double")


def normalised(scores: DataFrame, *by: str) -> DataFrame:
    """``score`` without negatives, divided by its sum over ``by``; 0 where the sum is 0."""
    pos = F.greatest(F.col("score"), F.lit(0.0))
    return scores.withColumn("score", F.coalesce(F.try_divide(pos, F.sum(pos).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def combine(scores: DataFrame) -> DataFrame:
    """(feature, score): the mean of the channels that have any positive evidence, normalised. ``scores`` has channel, feature, score."""
    mass = scores.groupBy("channel").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("_m")).where("_m > 0")
    kept = normalised(scores.join(F.broadcast(mass.select("channel")), "channel"), "channel")
    channels = mass.agg(F.count("*").alias("_k"))
    return normalised(kept.groupBy("feature").agg(F.sum("score").alias("_s")).join(F.broadcast(channels), F.lit(True)).select("feature", F.try_divide("_s", "_k").alias("score")))


def dimension_weights(combined: DataFrame) -> DataFrame:
    """(feature, dimension, dimension_weight, sub_weight) from combined evidence (feature, score)."""
    w = combined.join(F.broadcast(specs(combined.sparkSession)), "feature")
    in_dim = Window.partitionBy("dimension")
    w = w.withColumns({"_d": F.sum("score").over(in_dim), "_n": F.count("*").over(in_dim), "_h": F.sum(F.when(F.col("dimension") != "safety_bonus", F.col("score"))).over(Window.partitionBy(F.lit(0)))})
    bonus = F.col("dimension") == "safety_bonus"
    sub = F.when(bonus, F.coalesce(F.least(F.lit(BONUS_CAP), F.col("_d")) * F.try_divide("score", "_d"), F.lit(0.0))).otherwise(F.coalesce(F.try_divide("score", "_d"), 1.0 / F.col("_n")))
    return w.select("feature", "dimension", F.when(~bonus, F.try_divide("_d", "_h")).alias("dimension_weight"), sub.alias("sub_weight"))


def weights_of(table: DataFrame) -> Weights:
    """The weights of 16 rows of :func:`dimension_weights`."""
    rows = table.collect()
    if not rows or any(r["dimension_weight"] is None for r in rows if r["dimension"] != "safety_bonus"):
        raise ValueError("no evidence in any dimension of risk")
    dims = {r["dimension"]: r["dimension_weight"] for r in rows if r["dimension"] != "safety_bonus"}
    sub = {d: {r["feature"]: r["sub_weight"] for r in rows if r["dimension"] == d} for d in dims}
    return Weights(dims, sub, {r["feature"]: r["sub_weight"] for r in rows if r["dimension"] == "safety_bonus"}, "data_driven")


def weight_rows(channels: DataFrame) -> DataFrame:
    """(feature, dimension, dimension_weight, sub_weight) of every feature from the channels' scores; both weights are null where no dimension of risk has evidence."""
    w = dimension_weights(combine(channels))
    w = w.select("feature", "dimension_weight", "sub_weight", F.count("dimension_weight").over(Window.partitionBy(F.lit(0))).alias("_any"))
    return specs(channels.sparkSession).join(w, "feature", "left").select("feature", "dimension", "dimension_weight", F.when(F.col("_any") > 0, F.col("sub_weight")).alias("sub_weight"))


def channel_scores(cells: DataFrame, key: str = "cell", target: str = "accident_count", group: str = "district", permutations: int = 499) -> DataFrame:
    """(channel, feature, score) of the four channels of evidence, stored."""
    from pathwarden.operators.models import logistic_evidence, poisson_evidence

    parts = {
        "spearman": spearman_evidence(cells, target), "poisson": poisson_evidence(cells, FEATURES, target, group),
        "logistic": logistic_evidence(cells, FEATURES, "accident_label", group), "moran": moran_permutation(cells, key, FEATURES, target, permutations=permutations),
    }
    all_ = None
    for name, p in parts.items():
        one = p.select(F.lit(name).alias("channel"), "feature", "score")
        all_ = one if all_ is None else all_.unionByName(one)
    # A row for each channel and feature, made here and not inside a broadcast, which has a time limit.
    return stored(all_)[0]


def derive_weights(cells: DataFrame, key: str = "cell", target: str = "accident_count", group: str = "district", permutations: int = 499) -> tuple[Weights, DataFrame]:
    """Weights from the four channels of evidence, and the channels' scores; an error where no dimension of risk has evidence."""
    channels = channel_scores(cells, key, target, group, permutations)
    return weights_of(dimension_weights(combine(channels))), channels
