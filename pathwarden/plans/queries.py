"""A query for each operator over the tables, and its SQL where SQL can express it.

Averages and other floats are rounded as round(x + 1e-9, 6) on both sides: the shift moves
ties off the boundary, where the order of a sum would decide the digit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwarden import adapters as A
from pathwarden.functions import roads
from pathwarden.functions.semantics import clean_text
from pathwarden.operators import evaluation, evidence, graph, metrics, models, quality, regions, reports, routes, schools, scoring, segments, spatial
from pathwarden.sources.remote import DEMO_FEATURES, DEMO_SAFE, demo_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 1e-9, 6)


def q6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6)"


_CLIP = lambda c, d: f"greatest(least(coalesce(CAST({c} AS DOUBLE), {d}), 1.0), 0.0)"
_PARTS = {
    "risk": f"0.5 * {_CLIP('least(accident_count, 5) / 5.0::DOUBLE', 0)} + 0.3 * {_CLIP('traffic_volume_norm', 0)} + 0.2 * {_CLIP('avg_speed_norm', 0)}",
    "discomfort": f"0.5 * {_CLIP('narrow_sidewalk_norm', 0)} + 0.3 * {_CLIP('slope_norm', 0)} + 0.2 * {_CLIP('is_alley', 0)}",
    "congestion": f"0.4 * {_CLIP('pedestrian_flow_norm', 0)} + 0.4 * {_CLIP('academy_density_norm', 0)} + 0.2 * {_CLIP('bus_stop_nearby_norm', 0)}",
    "obstruction": f"0.6 * {_CLIP('illegal_parking_norm', 0)} + 0.4 * (1 - {_CLIP('light_density_norm', 0.5)})",
    "crossing": f"0.4 * (1 - {_CLIP('has_crosswalk', 0)}) + 0.4 * (1 - {_CLIP('has_signal', 0)}) + 0.2 * {_CLIP('lane_count_norm', 0)}",
    "safety_bonus": f"0.05 * {_CLIP('has_speed_bump', 0)} + 0.03 * {_CLIP('has_cctv', 0)} + 0.04 * {_CLIP('is_school_zone', 0)}",
}
_CMCS = "greatest(least(" + " + ".join(f"{w} * ({_PARTS[d]})" for d, w in scoring._DIMENSIONS.items()) + f" - ({_PARTS['safety_bonus']}), 1.0), 0.0)"
_SCORED_SQL = f"scored AS (SELECT *, {_CMCS} AS cmcs FROM {A.segments_sql()} s)"


def scored(spark: SparkSession, sf_dir: str, components: bool = False) -> DataFrame:
    df = A.segments(spark, sf_dir).withColumn("accident_count_norm", F.least("accident_count", F.lit(5)) / F.lit(5.0))
    return scoring.score(df, include_components=components)


@query(f"WITH {_SCORED_SQL} SELECT segment_id, {q6('cmcs')} AS cmcs FROM scored")
def score_segments(spark, sf_dir):
    return scored(spark, sf_dir).select("segment_id", r6("cmcs").alias("cmcs"))


@query(f"WITH {_SCORED_SQL} SELECT segment_id, " + ", ".join(f"{q6(x)} AS cmcs_{d}" for d, x in _PARTS.items()) + " FROM scored")
def score_components(spark, sf_dir):
    return scored(spark, sf_dir, True).select("segment_id", *[r6(f"cmcs_{d}").alias(f"cmcs_{d}") for d in _PARTS])


@query(f"WITH {_SCORED_SQL} SELECT segment_id, {q6('cmcs')} AS cmcs FROM scored ORDER BY 2 DESC, 1 LIMIT 100")
def topk_risk(spark, sf_dir):
    return scoring.top_risks(scored(spark, sf_dir).select("segment_id", r6("cmcs").alias("cmcs")), "cmcs", "segment_id", 100)


@query(f"""WITH {_SCORED_SQL}, s AS (SELECT segment_id, {q6('cmcs')} AS risk_score FROM scored),
q AS (SELECT quantile_cont(risk_score, 0.7) AS a, quantile_cont(risk_score, 0.9) AS b FROM s)
SELECT segment_id, CASE WHEN risk_score >= b THEN 'high' WHEN risk_score >= a THEN 'mid' ELSE 'normal' END AS risk_class FROM s, q""")
def risk_class_q70_q90(spark, sf_dir):
    df, _ = scoring.risk_score(scored(spark, sf_dir).select("segment_id", r6("cmcs").alias("cmcs")))
    return scoring.risk_classes(df).select("segment_id", "risk_class")


@query(f"""WITH {_SCORED_SQL}, s AS (SELECT segment_id, {q6('cmcs')} AS x FROM scored),
q AS (SELECT quantile_cont(x, 0.7) AS a, quantile_cont(x, 0.9) AS b FROM s),
c AS (SELECT CASE WHEN x >= b THEN 'high' WHEN x >= a THEN 'mid' ELSE 'normal' END AS risk_class, x FROM s, q)
SELECT risk_class, count(*) AS n, {q6('min(x)')} AS least, {q6('max(x)')} AS most, {q6('count(*) / (SELECT count(*) FROM c)::DOUBLE')} AS share FROM c GROUP BY 1""")
def map_summary(spark, sf_dir):
    df, _ = scoring.risk_score(scored(spark, sf_dir).select("segment_id", r6("cmcs").alias("cmcs")))
    return reports.map_summary(scoring.risk_classes(df)).select("risk_class", "n", r6("least").alias("least"), r6("most").alias("most"), r6("share").alias("share"))


# Cleaning
_POINTS = quality.PointSchema("points", ids=("sn",), dates=("referenceDate",), numeric=("latitude", "longitude", "occrrnc_cnt"), text=("name",), dedupe=("sn",), nonnegative=("occrrnc_cnt",))
_TYPED_SQL = f"""typed AS (SELECT *, try_cast(latitude AS DOUBLE) AS y, try_cast(longitude AS DOUBLE) AS x, greatest(try_cast(occrrnc_cnt AS DOUBLE), 0) AS c0,
  CASE WHEN try_cast(occrrnc_cnt AS DOUBLE) IS NULL THEN NULL ELSE greatest(try_cast(occrrnc_cnt AS DOUBLE), 0) END AS cnt FROM {A.raw_points_sql()} p),
sw AS (SELECT *, coalesce(y BETWEEN 127.29 AND 127.62 AND x BETWEEN 36.18 AND 36.55, false) AS swap FROM typed),
fx AS (SELECT *, CASE WHEN swap THEN x ELSE y END AS lat, CASE WHEN swap THEN y ELSE x END AS lon FROM sw),
va AS (SELECT *, coalesce(lat BETWEEN 36.18 AND 36.55 AND lon BETWEEN 127.29 AND 127.62, false) AS ok FROM fx)"""
_CLEAN_SQL = f"""{_TYPED_SQL}, b AS (SELECT quantile_cont(cnt, 0.005) AS lo, quantile_cont(cnt, 0.995) AS hi FROM typed),
k AS (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY _row_ord DESC) AS n FROM va WHERE ok),
cl AS (SELECT sn AS id, lat, lon, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') AS name, CASE WHEN cnt IS NULL THEN NULL ELSE greatest(least(cnt, hi), lo) END AS cnt, try_cast(referenceDate AS DATE) AS d,
  0.6 + 0.2 * (sn IS NOT NULL)::INT + 0.2 * (try_cast(referenceDate AS DATE) IS NOT NULL)::INT AS q FROM k, b WHERE n = 1)"""


@query(f"WITH {_CLEAN_SQL} SELECT id, {q6('lat')} AS lat, {q6('lon')} AS lon, name, {q6('cnt')} AS cnt, CAST(d AS VARCHAR) AS d, round(q, 3) AS q FROM cl")
def clean_points(spark, sf_dir):
    df, _ = quality.clean_points(A.raw_points(spark, sf_dir), "points", _POINTS)
    return df.select(
        F.col("_source_record_id").alias("id"), r6("_latitude").alias("lat"), r6("_longitude").alias("lon"), "name", r6("occrrnc_cnt").alias("cnt"),
        F.col("_observation_date").cast("date").cast("string").alias("d"), F.col("_row_quality_score").alias("q"),
    )


@query(f"WITH {_CLEAN_SQL} SELECT round(q, 3) AS q, count(*) AS n FROM cl GROUP BY 1")
def row_quality(spark, sf_dir):
    df, _ = quality.clean_points(A.raw_points(spark, sf_dir), "points", _POINTS)
    return df.groupBy(F.col("_row_quality_score").alias("q")).agg(F.count("*").alias("n"))


@query(f"WITH {_TYPED_SQL} SELECT _row_ord, {q6('lat')} AS lat, {q6('lon')} AS lon, swap, ok FROM va")
def swap_repair(spark, sf_dir):
    df = A.raw_points(spark, sf_dir)
    y, x = quality.to_double("latitude"), quality.to_double("longitude")
    swap = quality.swapped(y, x)
    out = df.select("_row_ord", F.when(swap, x).otherwise(y).alias("_y"), F.when(swap, y).otherwise(x).alias("_x"), swap.alias("swap"))
    return out.select("_row_ord", r6("_y").alias("lat"), r6("_x").alias("lon"), "swap", quality.in_city(F.col("_y"), F.col("_x")).alias("ok"))


@query(f"SELECT _row_ord, sn FROM (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY _row_ord DESC) AS n FROM {A.raw_points_sql()} p) WHERE n = 1")
def dedupe_keep_last(spark, sf_dir):
    return quality.keep_last(A.raw_points(spark, sf_dir).select("_row_ord", "sn"), ["sn"], "_row_ord")


@query(f"""WITH {_TYPED_SQL}, k AS (SELECT y, x, y IS NULL OR x IS NULL AS miss, coalesce(y BETWEEN 36.18 AND 36.55 AND x BETWEEN 127.29 AND 127.62, false) AS ok FROM typed)
SELECT count(*) AS total, count(*) FILTER (WHERE miss) AS missing, count(*) FILTER (WHERE NOT miss) - count(DISTINCT CASE WHEN NOT miss THEN round(y, 6) || ':' || round(x, 6) END) AS duplicate,
count(*) FILTER (WHERE NOT miss AND NOT ok) AS out_of_bbox, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 4) AS pass_rate FROM k""")
def coord_quality(spark, sf_dir):
    return quality.coordinate_quality(A.raw_points(spark, sf_dir), "latitude", "longitude")


@query(f"WITH {_TYPED_SQL} SELECT _row_ord FROM typed WHERE y IS NOT NULL AND x IS NOT NULL AND NOT (y BETWEEN 36.18 AND 36.55 AND x BETWEEN 127.29 AND 127.62) ORDER BY _row_ord LIMIT 20")
def coord_suspects(spark, sf_dir):
    return quality.suspects(A.raw_points(spark, sf_dir), "latitude", "longitude", "_row_ord").select("_row_ord")


@query(f"""WITH s AS (SELECT segment_id, CAST(crosswalk_count AS DOUBLE) AS c FROM {A.segments_sql(['segment_id', 'crosswalk_count'])} s),
q AS (SELECT quantile_cont(c, 0.005) AS lo, quantile_cont(c, 0.995) AS hi FROM s) SELECT segment_id, {q6('greatest(least(c, hi), lo)')} AS c FROM s, q""")
def winsorize_counts(spark, sf_dir):
    df = A.segments(spark, sf_dir, ["segment_id", "crosswalk_count"]).withColumn("c", F.col("crosswalk_count").cast("double"))
    return quality.winsorize(df, ["c"])[0].select("segment_id", r6("c").alias("c"))


@query(f"""WITH s AS (SELECT segment_id, light_density_norm AS v FROM {A.segments_sql(['segment_id', 'light_density_norm'])} s)
SELECT segment_id, {q6('coalesce(v, (SELECT median(v) FROM s))')} AS light FROM s""")
def median_impute(spark, sf_dir):
    df, _ = quality.prepare_for_analysis(A.segments(spark, sf_dir, ["segment_id", "light_density_norm"]))
    return df.select("segment_id", r6("light_density_norm").alias("light"))


@query(f"""WITH s AS (SELECT segment_id, CAST(crosswalk_count AS DOUBLE) AS c FROM {A.segments_sql(['segment_id', 'crosswalk_count'])} s),
w AS (SELECT segment_id, greatest(least(c, (SELECT quantile_cont(c, 0.995) FROM s)), (SELECT quantile_cont(c, 0.005) FROM s)) AS c FROM s),
q AS (SELECT quantile_cont(c, 0.25) AS a, quantile_cont(c, 0.75) AS b FROM w)
SELECT segment_id, CAST(b > a AND c > b + 3 * (b - a) AS INT) AS outlier FROM w, q""")
def iqr_flags(spark, sf_dir):
    df, _ = quality.prepare_for_analysis(A.segments(spark, sf_dir, ["segment_id", "crosswalk_count"]))
    flag = "_outlier_crosswalk_count"
    return df.select("segment_id", (F.col(flag) if flag in df.columns else F.lit(0)).alias("outlier"))


@query(f"""WITH s AS (SELECT segment_id, ln(1 + greatest(accident_count, 0)) AS v FROM {A.segments_sql(['segment_id', 'accident_count'])} s)
SELECT segment_id, {q6('CASE WHEN (SELECT max(v) - min(v) FROM s) <= 1e-8 THEN 0 ELSE (v - (SELECT min(v) FROM s)) / (SELECT max(v) - min(v) FROM s) END')} AS norm FROM s""")
def minmax_log(spark, sf_dir):
    return quality.minmax(A.segments(spark, sf_dir, ["segment_id", "accident_count"]), "accident_count", "v", True).select("segment_id", r6("v").alias("norm"))


@query(f"SELECT (SELECT count(*) FROM orders) AS before, (SELECT count(*) FROM {A.segments_sql(['segment_id'])} s) AS after, abs((SELECT count(*) FROM {A.segments_sql(['segment_id'])} s) - (SELECT count(*) FROM orders)) / (SELECT count(*) FROM orders)::DOUBLE > 0.1 AS drift")
def drift_check(spark, sf_dir):
    a, b = A.table(spark, sf_dir, "orders").count(), A.segments(spark, sf_dir, ["segment_id"]).count()
    return spark.createDataFrame([(a, b, quality.drifted(a, b))], "before long, after long, drift boolean")


# Scalars
_ROADS = {
    "highway": "element_at(split('residential,primary,footway,service,unknown', ','), cast(o_orderkey % 5 as int) + 1)",
    "maxspeed": "case o_orderkey % 4 when 0 then '50 mph' when 1 then null when 2 then concat('[', chr(39), '30', chr(39), ', ', chr(39), '40', chr(39), ']') else 'none' end",
    "lanes": "case o_orderkey % 3 when 0 then '2;3' when 1 then null else '4' end",
    "sidewalk": "case o_orderkey % 7 when 0 then 'Both' when 1 then 'no' else null end",
    "incline": "case o_orderkey % 6 when 0 then '-20%' when 1 then '3' else null end",
    "lit": "case o_orderkey % 8 when 0 then 'yes' when 1 then 'NO' else 'limited' end",
}


@query(f"""WITH r AS (SELECT o_orderkey, {', '.join(f"{e.replace('element_at(split', 'list_extract(string_split')} AS {n}" for n, e in _ROADS.items())} FROM orders),
d AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {t}, {s})" for c, t, s in roads.ROAD_CLASSES)}) t(c, t, s))
SELECT o_orderkey, {q6('coalesce(t, 0.25)')} AS traffic, {q6("coalesce(try_cast(regexp_extract(maxspeed, '[0-9]+(\\.[0-9]+)?') AS DOUBLE), s, 25.0)")} AS speed,
{q6("coalesce(try_cast(regexp_extract(lanes, '[0-9]+(\\.[0-9]+)?') AS DOUBLE), 1.0)")} AS lanes,
{q6("CASE WHEN highway = 'footway' THEN 0.05 WHEN lower(sidewalk) = 'both' THEN 0.2 WHEN lower(sidewalk) = 'no' THEN 1.0 WHEN highway = 'primary' THEN 0.72 ELSE 0.55 END")} AS narrow,
{q6("least(coalesce(try_cast(regexp_extract(incline, '[0-9]+(\\.[0-9]+)?') AS DOUBLE), 0.0) / 15.0, 1.0)")} AS slope, {q6("(highway = 'service')::INT")} AS alley,
{q6("CASE lower(lit) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 ELSE 0.5 END")} AS lit FROM r LEFT JOIN d ON d.c = r.highway""")
def road_lookup_left_join(spark, sf_dir):
    df = A.table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _ROADS.items()])
    out = roads.road_features(df)
    names = {"traffic": "traffic_volume_proxy", "speed": "avg_speed_kph", "lanes": "lane_count", "narrow": "narrow_sidewalk_proxy", "slope": "slope_proxy", "alley": "is_alley", "lit": "lit_tag_score"}
    return out.select("o_orderkey", *[r6(c).alias(n) for n, c in names.items()])


@query(f"WITH {A.GRAPH_SQL} SELECT DISTINCT 'S-' || least(u::VARCHAR, v::VARCHAR) || '-' || greatest(u::VARCHAR, v::VARCHAR) || '-' || list_aggregate(list_sort([(u + v)::VARCHAR, '7']), 'string_agg', '-') AS id FROM g")
def segment_id_canonical(spark, sf_dir):
    g = A.graph(spark, sf_dir)
    osmid = F.concat(F.lit("['"), (F.col("u") + F.col("v")).cast("string"), F.lit("', '7']"))
    return g.select(roads.segment_id(F.col("u"), F.col("v"), osmid).alias("id")).distinct()


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '유성구' WHEN c_custkey % 3 = 1 THEN '중구' ELSE NULL END AS district, nullif(trim(regexp_replace(c_name, '\\s+', ' ', 'g')), '') AS name FROM customer")
def district_extract(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    text = F.concat(F.lit("대전광역시 "), F.element_at(F.array(F.lit("유성구 1로"), F.lit("중구 유성구"), F.lit("시내")), (F.col("c_custkey") % 3).cast("int") + 1))
    return c.select("c_custkey", roads.extract_district(text).alias("district"), clean_text("c_name").alias("name"))


_HOUR = "o_orderkey % 24"
_LM = "CASE WHEN h < 6 OR h >= 21 THEN 1.8 ELSE 1.0 END"
_CM = "CASE WHEN h < 6 OR h >= 21 THEN 0.6 WHEN (h >= 7 AND h < 9) OR (h >= 16 AND h < 19) THEN 1.5 ELSE 1.0 END"


@query(f"""WITH h AS (SELECT unnest(range(0, 24)) AS h), a AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}, {y})" for n, x, y in roads.AGE_PROFILES)}) t(age, lam, detour))
SELECT age, CAST(h AS INT) AS hour, {q6('lam')} AS lam, {q6('detour')} AS detour, {q6(_LM)} AS light, {q6(_CM)} AS crowd,
CASE WHEN h >= 7 AND h < 9 THEN 'to_school' WHEN h >= 9 AND h < 16 THEN 'day' WHEN h >= 16 AND h < 19 THEN 'from_school' ELSE 'night' END AS label FROM h, a""")
def age_time_profile(spark, sf_dir):
    ages = spark.createDataFrame(roads.AGE_PROFILES, "age string, lam double, detour double")
    h = F.col("hour")
    out = ages.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return out.select("age", "hour", r6("lam").alias("lam"), r6("detour").alias("detour"), r6(roads.light_multiplier(h)).alias("light"), r6(roads.congestion_multiplier(h)).alias("crowd"), roads.time_label(h).alias("label"))


@query(f"""WITH {_SCORED_SQL}, t AS (SELECT segment_id, cmcs, light_density_norm AS l, CAST(length_m AS INT) % 24 AS h FROM scored),
a AS (SELECT *, greatest(least(cmcs + (({_LM}) - 1.0) * (1.0 - greatest(least(coalesce(l, 0.5), 1.0), 0.0)) * 0.15, 1.0), 0.0) AS x FROM t)
SELECT segment_id, {q6(f'greatest(least(x + (({_CM}) - 1.0) * 0.05, 1.0), 0.0)')} AS adjusted FROM a""")
def time_adjusted_score(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.select("segment_id", r6(roads.time_adjusted(F.col("cmcs"), F.col("length_m").cast("int") % 24, F.coalesce("light_density_norm", F.lit(0.5)))).alias("adjusted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE round_even((100 + o_orderkey % 777)::DOUBLE / (o_orderkey % 9 * 37), 4) END AS ratio,
CASE WHEN o_orderkey % 9 = 0 THEN false ELSE (100 + o_orderkey % 777)::DOUBLE / (o_orderkey % 9 * 37) > 2.0 END AS exceeded FROM orders""")
def detour_check(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    ratio, over = roads.detour((F.col("o_orderkey") % 9 * 37).cast("double"), (100 + F.col("o_orderkey") % 777).cast("double"), F.lit(2.0))
    return o.select("o_orderkey", ratio.alias("ratio"), over.alias("exceeded"))


@query("SELECT name, address FROM (SELECT c_name AS name, c_mktsegment AS address, 'D' || c_nationkey % 5 AS district FROM customer) WHERE district = 'D2' AND (contains(lower(name), 'r#0') OR contains(lower(address), 'build') OR contains(lower(name), 'build') OR contains(lower(address), 'r#0')) AND (contains(lower(name), 'build') OR contains(lower(address), 'build')) ORDER BY 1, 2 LIMIT 10")
def search_names(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"), F.concat(F.lit("D"), (F.col("c_nationkey") % 5).cast("string")).alias("district"))
    return reports.search(c, "Build", "D2").select("name", "address")


# Aggregations
# Fixed values, written here by themselves so that a wrong list in the operator shows; the tables have no counts made relative, which are 0 then.
_SQL_MEANS = ["length_m", "traffic_volume_norm", "avg_speed_norm", "narrow_sidewalk_norm", "slope_norm", "is_alley", "pedestrian_flow_norm", "academy_density_norm", "bus_stop_nearby_norm", "illegal_parking_norm", "light_density_norm", "has_crosswalk", "has_signal", "lane_count_norm", "has_speed_bump", "has_cctv", "is_school_zone", "crosswalk_count_norm", "signal_count_norm", "speed_bump_count_norm"]
_SQL_SPREADS = ["traffic_volume_norm", "avg_speed_norm", "narrow_sidewalk_norm", "slope_norm", "pedestrian_flow_norm", "bus_stop_nearby_norm", "illegal_parking_norm", "lane_count_norm"]
_SQL_SUMS = ["length_m", "crosswalk_count", "signal_count", "speed_bump_count", "bus_stop_count", "streetlight_count", "school_zone_cctv_count", "is_school_zone", "has_crosswalk", "has_signal", "has_speed_bump", "has_cctv"]
_SQL_ABSENT = ("crosswalk_count_norm", "signal_count_norm", "speed_bump_count_norm")
_REGION_SQL = f"""s AS (SELECT coalesce(district, '미분류') AS district, CAST(floor(center_x / 1750) AS BIGINT) AS region_x, CAST(floor(center_y / 1750) AS BIGINT) AS region_y, center_x, center_y, highway,
  (accident_count > 0)::INT AS accident_label, {', '.join(f'CAST(0 AS DOUBLE) AS {c}' if c in _SQL_ABSENT else f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in dict.fromkeys(_SQL_MEANS + _SQL_SPREADS + _SQL_SUMS))} FROM {A.segments_sql()} s),
r AS (SELECT district, region_x, region_y, {', '.join(f'avg({c}) AS {c}' for c in _SQL_MEANS)}, avg(center_x) AS center_x, avg(center_y) AS center_y, count(*) AS segment_count, max(accident_label) AS accident_label,
  {', '.join(f'max({c}) AS {c}_max, coalesce(stddev_samp({c}), 0) AS {c}_std, quantile_cont({c}, 0.9) AS {c}_q90' for c in _SQL_SPREADS)}, {', '.join(f'sum({c}) AS {c}_sum' for c in _SQL_SUMS)},
  {', '.join(f"avg((highway = '{h}')::INT) AS hw_share_{h}" for h in A.HIGHWAYS[:-1])}, avg((highway NOT IN ({', '.join(repr(h) for h in A.HIGHWAYS[:-1])}))::INT) AS hw_share_other FROM s GROUP BY 1, 2, 3)"""
_REGION_OUT = (
    _SQL_MEANS + ["center_x", "center_y"] + [f"{c}_{k}" for c in _SQL_SPREADS for k in ("max", "std", "q90")] + [f"{c}_sum" for c in _SQL_SUMS] + [f"hw_share_{h}" for h in A.HIGHWAYS]
)


@query(f"""WITH {_REGION_SQL} SELECT district, region_x, region_y, segment_count, accident_label, {', '.join(f'{q6(c)} AS {c}' for c in _REGION_OUT)},
{q6('ln(1 + segment_count)')} AS log_segment_count, {q6('length_m_sum / 1000.0')} AS road_length_km, {', '.join(f'{q6(f"{c}_sum / greatest(length_m_sum / 1000.0, 0.05)")} AS {o}' for c, o in regions.PER_KM.items())},
{', '.join(f'{q6(f"{c}_sum / segment_count")} AS {o}' for c, o in regions.COVERAGE.items())},
{q6(' + '.join(f'{w} * {c}' for c, w in regions.HAZARD_MEAN.items()) + ' + ' + ' + '.join(f'{w} * (1 - {c})' for c, w in regions.HAZARD_LACKS.items()))} AS structural_hazard_mean,
{q6(' + '.join(f'{w} * {c}_max' for c, w in regions.HAZARD_PEAK.items()) + ' + 0.1 * (1 - light_density_norm)')} AS structural_hazard_peak FROM r""")
def region_features(spark, sf_dir):
    df = regions.region_features(A.segments(spark, sf_dir))
    floats = [*_REGION_OUT, "log_segment_count", "road_length_km", *regions.PER_KM.values(), *regions.COVERAGE.values(), "structural_hazard_mean", "structural_hazard_peak"]
    return df.select("district", "region_x", "region_y", "segment_count", "accident_label", *[r6(c).alias(c) for c in floats])


@query(f"""SELECT district, {', '.join(f"{q6(f"avg((highway = '{h}')::INT)")} AS hw_share_{h}" for h in A.HIGHWAYS[:-1])}, {q6(f"avg((highway NOT IN ({', '.join(repr(h) for h in A.HIGHWAYS[:-1])}))::INT)")} AS hw_share_other
FROM {A.segments_sql(['district', 'highway'])} s GROUP BY 1""")
def highway_share_pivot(spark, sf_dir):
    df = regions.highway_shares(A.segments(spark, sf_dir, ["district", "highway"]), ["district"])
    return df.select("district", *[r6(f"hw_share_{h}").alias(f"hw_share_{h}") for h in A.HIGHWAYS])


_KINDS = ["view", "signup", "click", "error", "purchase"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}_count" for k in _KINDS) + " FROM events GROUP BY 1")
def facility_count_pivot(spark, sf_dir):
    return regions.count_pivot(A.table(spark, sf_dir, "events"), "user_id", "event_type", _KINDS)


@query(f"""WITH {_SCORED_SQL} SELECT district, {q6('avg(cmcs)')} AS average_cmcs, {q6('avg((cmcs >= 0.6)::INT)')} AS high_risk_ratio, {q6('avg((accident_count > 0)::INT)')} AS accident_labeled_ratio,
{q6('avg((has_crosswalk + has_signal + has_speed_bump + has_cctv) / 4.0)')} AS infrastructure_coverage, {q6('avg(1 - narrow_sidewalk_norm)')} AS walking_comfort, count(*) AS segment_count FROM scored WHERE district IS NOT NULL GROUP BY 1""")
def district_summary(spark, sf_dir):
    df = regions.district_summary(scored(spark, sf_dir), "cmcs")
    return df.select("district", *[r6(c).alias(c) for c in ("average_cmcs", "high_risk_ratio", "accident_labeled_ratio", "infrastructure_coverage", "walking_comfort")], "segment_count")


@query(f"SELECT highway, count(*) AS count FROM {A.segments_sql(['highway'])} s WHERE highway IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return reports.value_counts(A.segments(spark, sf_dir, ["highway"]), "highway")


@query(f"""WITH s AS (SELECT *, coalesce(light_density_norm, (SELECT median(light_density_norm) FROM {A.segments_sql(['light_density_norm'])} m)) AS light FROM {A.segments_sql()} s),
c AS (SELECT coalesce(district, '미분류') AS district, CAST(floor(center_x / 500) AS BIGINT) AS region_x, CAST(floor(center_y / 500) AS BIGINT) AS region_y, count(*) AS segment_count, sum(length_m) AS length_m,
  max((accident_count > 0)::INT) AS accident_label, {', '.join(f"avg({'1 - light' if f == 'light_deficit' else '1 - has_crosswalk' if f == 'crosswalk_deficit' else '1 - has_signal' if f == 'signal_deficit' else f}) AS {f}" for f in evidence.FEATURES)} FROM s GROUP BY 1, 2, 3)
SELECT district, region_x, region_y, segment_count, {q6('length_m')} AS length_m, accident_label, {', '.join(f'{q6(f)} AS {f}' for f in evidence.FEATURES)} FROM c""")
def weight_table(spark, sf_dir):
    df = regions.evidence_table(A.segments(spark, sf_dir), evidence.FEATURES)
    return df.select("district", "region_x", "region_y", "segment_count", r6("length_m").alias("length_m"), "accident_label", *[r6(f).alias(f) for f in evidence.FEATURES])


# Joins by distance
_HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(1 - h, 0)))"
_PAIRS_SQL = f"""{A.FACILITIES_SQL}, pr AS (SELECT *, {_HAV} AS d FROM (SELECT o.origin, t.target, t.flag, t.size,
  power(sin((radians(t.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(t.lat)) * power(sin((radians(t.lon) - radians(o.lon)) / 2), 2) AS h FROM o, t))"""


@query(f"WITH {_PAIRS_SQL} SELECT origin, " + ", ".join(f"count(*) FILTER (WHERE d <= {r}) AS within_{r}" for r in (100, 300, 500)) + " FROM pr GROUP BY 1")
def radius_counts(spark, sf_dir):
    return spatial.radius_counts(*A.facilities(spark, sf_dir), "origin", [100, 300, 500])


@query(f"""WITH {_PAIRS_SQL} SELECT origin, {q6("coalesce(count(*) FILTER (WHERE d <= 500 AND upper(flag) = 'Y') / nullif(count(*) FILTER (WHERE d <= 500), 0)::DOUBLE, 0)")} AS ratio, {q6('coalesce(avg(size) FILTER (WHERE d <= 500), 0)')} AS mean FROM pr GROUP BY 1""")
def nearby_ratio(spark, sf_dir):
    df = spatial.nearby_stats(*A.facilities(spark, sf_dir), "origin", "flag", "size", 500)
    return df.select("origin", r6("ratio").alias("ratio"), r6("mean").alias("mean"))


@query(f"WITH {_PAIRS_SQL} SELECT origin, arg_min(target, (d, target)) AS target, {q6('min(d)')} AS distance FROM pr GROUP BY 1")
def nearest_facility(spark, sf_dir):
    return spatial.nearest(*A.facilities(spark, sf_dir), "origin", "target").select("origin", "target", r6("distance").alias("distance"))


_PLANE = "SELECT s_suppkey AS id, (s_suppkey * 7919 % 10007)::DOUBLE AS x, (s_suppkey * 104729 % 10009)::DOUBLE AS y FROM supplier"


def _plane(spark, sf_dir):
    return A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("cast(s_suppkey * 7919 % 10007 as double)").alias("x"), F.expr("cast(s_suppkey * 104729 % 10009 as double)").alias("y"))


@query(f"""WITH p AS ({_PLANE}), d AS (SELECT a.id, b.id AS neighbour, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM p a JOIN p b ON a.id <> b.id)
SELECT id, neighbour, d2, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS n FROM d) WHERE n <= 8""")
def knn_pairs(spark, sf_dir):
    return spatial.knn(_plane(spark, sf_dir), "id").select("id", "neighbour", "d2", "n")


@query(f"WITH p AS ({_PLANE}) SELECT a.id AS l, b.id AS r, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 300.0 * 300.0")
def radius_join(spark, sf_dir):
    p = _plane(spark, sf_dir)
    return spatial.radius_pairs(p, p, 300.0).select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), "d2")


@query(f"""WITH {A.FACILITIES_SQL}, pr AS (SELECT *, {_HAV} AS d FROM (SELECT a.origin AS a, b.origin AS b,
  power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2) AS h FROM o a JOIN o b ON a.origin <> b.origin)),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(d - 1600), b) AS n FROM pr WHERE d >= 700 AND d <= 3000)
SELECT least(a, b) AS origin, greatest(a, b) AS destination, {q6('min(d)')} AS distance FROM k WHERE n = 1 GROUP BY 1, 2""")
def od_pairs_band(spark, sf_dir):
    o, _ = A.facilities(spark, sf_dir)
    return spatial.band_pairs(o, "origin").select("origin", "destination", r6("distance").alias("distance"))


@query(f"""WITH {A.FACILITIES_SQL}, q AS (SELECT *, 'D' || origin % 5 AS district, CAST(origin * 7919 % 1009 AS VARCHAR) AS name FROM o),
i AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY name, origin) - 1 AS i, count(*) OVER (PARTITION BY district) AS n FROM q),
c AS (SELECT * FROM (SELECT *, least(n, (SELECT ceil(25 / count(DISTINCT district)) FROM q)) AS k FROM i) WHERE list_contains(list_transform(range(0, CAST(k AS BIGINT)), lambda x: CASE WHEN k > 1 THEN CAST(floor(x * (n - 1) / (k - 1)) AS BIGINT) ELSE 0 END), i)),
pr AS (SELECT *, {_HAV} AS d FROM (SELECT a.origin AS a, a.district, a.name, b.origin AS b,
  power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2) AS h FROM c a JOIN o b ON a.origin <> b.origin)),
m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(d - 1600), b) AS r FROM pr WHERE d >= 700 AND d <= 3000), u AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY district, name, a) AS z FROM m WHERE r = 1)
SELECT a AS origin, b AS destination, {q6('d')} AS distance, district FROM u WHERE z = 1""")
def od_pairs_by_district(spark, sf_dir):
    o, _ = A.facilities(spark, sf_dir)
    named = o.withColumns({"district": F.concat(F.lit("D"), (F.col("origin") % 5).cast("string")), "name": (F.col("origin") * 7919 % 1009).cast("string")})
    return spatial.district_pairs(named, "origin", "name", "district").select("origin", "destination", r6("distance").alias("distance"), "district")


@query(f"""WITH RECURSIVE {A.FACILITIES_SQL}, l AS (SELECT a, b FROM (SELECT a.origin AS a, b.origin AS b,
  power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2) AS h FROM o a JOIN o b ON a.origin <> b.origin) WHERE {_HAV} <= 1000),
reach AS (SELECT origin AS s, origin AS t FROM o UNION SELECT r.s, l.b FROM reach r JOIN l ON r.t = l.a) SELECT s AS origin, min(t) AS cluster FROM reach GROUP BY 1""")
def hotspot_components(spark, sf_dir):
    o, _ = A.facilities(spark, sf_dir)
    return spatial.clusters(o, "origin", 1000.0)


_GRID_SQL = "SELECT region_x, region_y FROM (SELECT unnest(range(0, 4)) AS region_x), (SELECT unnest(range(0, 4)) AS region_y)"


@query(f"WITH p AS ({_PLANE}) SELECT id, 'Z' || CAST(floor(x / 2600) AS BIGINT) || CAST(floor(y / 2600) AS BIGINT) AS zone FROM p")
def point_in_polygon(spark, sf_dir):
    z = spark.range(16).select((F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("j"))
    xy = lambda a, b: F.struct(((F.col("i") + a) * 2600.0 - 0.5 * (a == 0) - 0.5 * (a == 1)).alias("x"), ((F.col("j") + b) * 2600.0 - 0.5 * (b == 0) - 0.5 * (b == 1)).alias("y"))
    polygons = z.select(F.concat(F.lit("Z"), F.col("i").cast("string"), F.col("j").cast("string")).alias("zone"), F.array(xy(0, 0), xy(1, 0), xy(1, 1), xy(0, 1)).alias("ring"))
    return spatial.within(_plane(spark, sf_dir), polygons, "id", "zone").select("id", "zone")


@query(f"""WITH p AS ({_PLANE}), e AS (SELECT 'L' || k AS edge, k * 500.0 AS y FROM (SELECT unnest(range(0, 21)) AS k)),
d AS (SELECT id, edge, abs(p.y - e.y) AS d FROM p, e) SELECT id, {q6('min(d)')} AS distance, min_by(edge, (d, edge)) AS edge FROM d GROUP BY 1""")
def nearest_edge(spark, sf_dir):
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.alias("y"))
    y = F.col("id") * 500.0
    edges = spark.range(21).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("edge"), F.array(pt(-10.0, y), pt(5000.0, y), pt(20000.0, y)).alias("line"))
    return spatial.nearest_edge(_plane(spark, sf_dir), edges, "id", "edge").select("id", "edge", r6("distance").alias("distance"))


_SQUARES = "z AS (SELECT 'Z' || i || j AS zone, i * 2600.0 + 700 AS x0, j * 2600.0 + 400 AS y0 FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j))"


@query(f"""WITH p AS ({_PLANE}), {_SQUARES}, d AS (SELECT id, zone, power(greatest(x0 - x, x - x0 - 900, 0), 2) + power(greatest(y0 - y, y - y0 - 1100, 0), 2) AS d FROM p, z)
SELECT id, min_by(zone, (d, zone)) AS zone FROM d GROUP BY 1""")
def nearest_polygon(spark, sf_dir):
    # Most points are outside all squares.
    z = spark.range(16).select(((F.col("id") / 4).cast("int") * 2600.0 + 700).alias("x0"), ((F.col("id") % 4) * 2600.0 + 400).alias("y0"), F.concat(F.lit("Z"), (F.col("id") / 4).cast("int").cast("string"), (F.col("id") % 4).cast("string")).alias("zone"))
    xy = lambda a, b: F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y"))
    polygons = z.select("zone", F.array(xy(0, 0), xy(900, 0), xy(900, 1100), xy(0, 1100)).alias("ring"))
    return spatial.within(_plane(spark, sf_dir), polygons, "id", "zone").select("id", "zone")


def _off(p: str, a: str, b: str) -> str:
    """SQL: the squared distance of a point from a segment; points are named by prefix."""
    t = f"greatest(0, least(1, coalesce((({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / nullif(power({b}x - {a}x, 2) + power({b}y - {a}y, 2), 0), 0)))"
    return f"(power({p}x - {a}x - {t} * ({b}x - {a}x), 2) + power({p}y - {a}y - {t} * ({b}y - {a}y), 2))"


_TURN = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


@query(f"""WITH p AS ({_PLANE}), e AS (SELECT id, x AS ax, y AS ay, x + 1600.0 * (id % 3 - 1) AS fx, y + 300.0 * (id % 7 - 3) AS fy FROM p),
r AS (SELECT * FROM (VALUES (1000.0::DOUBLE, 1000.0::DOUBLE, 4000.0::DOUBLE, 9000.0::DOUBLE), (4000.0, 9000.0, 9000.0, 2000.0)) t(cx, cy, dx, dy))
SELECT DISTINCT id FROM e, r WHERE ({_TURN('a', 'f', 'c')} * {_TURN('a', 'f', 'd')} < 0 AND {_TURN('c', 'd', 'a')} * {_TURN('c', 'd', 'f')} < 0)
OR least({_off('a', 'c', 'd')}, {_off('f', 'c', 'd')}, {_off('c', 'a', 'f')}, {_off('d', 'a', 'f')}) <= 90000""")
def route_buffer(spark, sf_dir):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    i, x, y = F.col("id"), F.col("x"), F.col("y")
    edges = _plane(spark, sf_dir).select("id", F.array(pt(x, y), pt(x + 1600.0 * (i % 3 - 1), y + 300.0 * (i % 7 - 3))).alias("line"))
    route = spark.range(1).select(F.array(*(pt(F.lit(a), F.lit(b)) for a, b in ((1000, 1000), (4000, 9000), (9000, 2000)))).alias("line"))
    return spatial.route_buffer(edges, route, "id", 300.0).select("id")


# Evidence
_TAB = ["traffic_volume_norm", "avg_speed_norm", "pedestrian_flow_norm", "illegal_parking_norm", "is_alley"]


@query(f"""WITH s AS (SELECT accident_count AS y, {', '.join(_TAB)} FROM {A.segments_sql()} s), u AS (UNPIVOT (SELECT y, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _TAB)} FROM s) ON {', '.join(_TAB)} INTO NAME feature VALUE x),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM u)
SELECT feature, count(*) AS n, {q6('corr(rx, ry)')} AS rho FROM k GROUP BY 1""")
def spearman(spark, sf_dir):
    return evidence.spearman(A.segments(spark, sf_dir), _TAB, "accident_count").select("feature", "n", r6("rho").alias("rho"))


@query(f"""WITH c AS (SELECT CAST(floor(center_x / 2000) * 1000 + floor(center_y / 2000) AS BIGINT) AS cell, avg(center_x) AS x, avg(center_y) AS y, avg(traffic_volume_norm) AS f, sum(accident_count)::DOUBLE AS t FROM {A.segments_sql()} s GROUP BY 1),
z AS (SELECT cell, x, y, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS zx, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS zy FROM c),
n AS (SELECT a.cell, b.zy, row_number() OVER (PARTITION BY a.cell ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell) AS k FROM z a JOIN z b ON a.cell <> b.cell),
l AS (SELECT cell, avg(zy) AS lag FROM n WHERE k <= 8 GROUP BY 1) SELECT 'traffic_volume_norm' AS feature, {q6('sum(zx * lag) / sum(zx * zx)')} AS moran FROM z JOIN l USING (cell)""")
def bivariate_moran(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return evidence.bivariate_moran(c, "cell", ["traffic_volume_norm"], "accident_count").select("feature", r6("moran").alias("moran"))


def _cells(spark, sf_dir):
    s = A.segments(spark, sf_dir)
    key = (F.floor(F.col("center_x") / 2000) * 1000 + F.floor(F.col("center_y") / 2000)).cast("long")
    return s.groupBy(key.alias("cell")).agg(F.avg("center_x").alias("center_x"), F.avg("center_y").alias("center_y"), *[F.avg(f).alias(f) for f in _TAB], F.sum("accident_count").cast("double").alias("accident_count"))


_SPEC_ROWS = ", ".join(f"('{f}', '{d}', {i % 7 - 2}, {(i * 5) % 11 - 3})" for i, (f, d, _) in enumerate(evidence.SPECS))
_COMBINE_SQL = f"""v AS (SELECT * FROM (VALUES {_SPEC_ROWS}) t(feature, dimension, a, b)), m AS (SELECT feature, dimension, (greatest(a, 0) / (SELECT sum(greatest(a, 0)) FROM v)::DOUBLE + greatest(b, 0) / (SELECT sum(greatest(b, 0)) FROM v)::DOUBLE) / 2 AS s FROM v),
c AS (SELECT feature, dimension, s / (SELECT sum(s) FROM m) AS score FROM m)"""


def _channels(spark):
    rows = [(ch, f, float(v)) for i, (f, _, _) in enumerate(evidence.SPECS) for ch, v in (("a", i % 7 - 2), ("b", (i * 5) % 11 - 3), ("none", -1))]
    return spark.createDataFrame(rows, "channel string, feature string, score double")


@query(f"WITH {_COMBINE_SQL} SELECT feature, {q6('score')} AS score FROM c")
def l1_combine(spark, sf_dir):
    return evidence.combine(_channels(spark)).select("feature", r6("score").alias("score"))


@query(f"""WITH {_COMBINE_SQL}, d AS (SELECT *, sum(score) OVER (PARTITION BY dimension) AS m, count(*) OVER (PARTITION BY dimension) AS n, sum(CASE WHEN dimension <> 'safety_bonus' THEN score END) OVER () AS h FROM c)
SELECT feature, dimension, {q6("CASE WHEN dimension <> 'safety_bonus' THEN m / h END")} AS dimension_weight,
{q6("CASE WHEN dimension = 'safety_bonus' THEN coalesce(least(0.15, m) * score / nullif(m, 0), 0) ELSE coalesce(score / nullif(m, 0), 1.0 / n) END")} AS sub_weight FROM d""")
def dimension_weights(spark, sf_dir):
    df = evidence.dimension_weights(evidence.combine(_channels(spark)))
    return df.select("feature", "dimension", r6("dimension_weight").alias("dimension_weight"), r6("sub_weight").alias("sub_weight"))


# Metrics
_PRED = ["district", "accident_count", "traffic_volume_norm"]
_PRED_SQL = f"p AS (SELECT coalesce(district, 'none') AS g, (accident_count > 0)::INT AS y, round(traffic_volume_norm, 3) AS p FROM {A.segments_sql(_PRED)} s)"


def _predictions(spark, sf_dir):
    return A.segments(spark, sf_dir, _PRED).select(F.coalesce("district", F.lit("none")).alias("g"), (F.col("accident_count") > 0).cast("int").alias("y"), F.round("traffic_volume_norm", 3).alias("p"))


_RANK_SQL = f"""{_PRED_SQL}, c AS (SELECT g, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM p GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY g ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY g) AS pp, sum(neg) OVER (PARTITION BY g) AS nn FROM c),
f AS (SELECT *, 2.0 * tp / (tp + fp + pp) AS f1 FROM w), k AS (SELECT g, p AS t, f1, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, p) AS n FROM f),
m AS (SELECT g, sum(pos + neg) AS n, sum(pos * (nn - fp + neg / 2.0::DOUBLE)) / nullif(max(pp) * max(nn), 0) AS roc_auc, CASE WHEN max(pp) * max(nn) > 0 THEN sum(pos * tp / (tp + fp)::DOUBLE) / max(pp) END AS average_precision,
  sum(pos * (1 - p) ** 2 + neg * p ** 2) / sum(pos + neg) AS brier, max(pp) / sum(pos + neg)::DOUBLE AS prevalence FROM w GROUP BY 1)"""


@query(f"WITH {_RANK_SQL} SELECT m.g, CAST(m.n AS BIGINT) AS n, {q6('roc_auc')} AS roc_auc, {q6('average_precision')} AS average_precision, {q6('brier')} AS brier, {q6('k.t')} AS f1_threshold, {q6('k.f1')} AS f1_best FROM m JOIN k ON k.g = m.g AND k.n = 1")
def ranking_metrics(spark, sf_dir):
    df = metrics.ranking_metrics(_predictions(spark, sf_dir), "y", "p", ["g"])
    return df.select("g", "n", *[r6(c).alias(c) for c in ("roc_auc", "average_precision", "brier", "f1_threshold", "f1_best")])


@query(f"WITH {_RANK_SQL} SELECT g, CAST(n AS BIGINT) AS n, {q6('prevalence')} AS prevalence, {q6('average_precision / prevalence')} AS ap_lift, {q6('1 - brier / (prevalence * (1 - prevalence))')} AS brier_skill FROM m")
def regional_metrics(spark, sf_dir):
    df = metrics.regional_metrics(_predictions(spark, sf_dir), "y", "p", ["g"])
    return df.select("g", "n", *[r6(c).alias(c) for c in ("prevalence", "ap_lift", "brier_skill")])


@query(f"""WITH {_PRED_SQL}, c AS (SELECT g, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM p GROUP BY 1)
SELECT g, tn, fp, fn, tp, {q6('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS precision, {q6('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall, {q6('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
{q6('coalesce((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, tp / nullif(tp + fn, 0)::DOUBLE, tn / nullif(tn + fp, 0)::DOUBLE, 0)')} AS balanced_accuracy FROM c""")
def confusion_by_group(spark, sf_dir):
    df = metrics.confusion(_predictions(spark, sf_dir), "y", F.col("p") >= 0.5, ["g"])
    return df.select("g", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


@query(f"""WITH {_PRED_SQL}, e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q, min(p) AS lo, max(p) AS hi FROM p),
b AS (SELECT y, p, len(list_filter(q, lambda x: x > lo AND x < hi AND x < p)) AS b FROM p, e), g AS (SELECT b, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, {q6('sum(n * gap) / sum(n)')} AS ece FROM g""")
def ece(spark, sf_dir):
    df = metrics.calibration_error(_predictions(spark, sf_dir), "y", "p")
    return df.select("n", r6("ece").alias("ece"))


# Graph
_COST_SQL = f"{A.GRAPH_SQL}, c AS (SELECT *, length * cmcs AS risk_exposure, length * (0.05 + cmcs) AS safety_cost FROM g)"
_START = "(SELECT min(u) FROM g)"


def _graph(spark, sf_dir):
    return graph.edge_costs(A.graph(spark, sf_dir))


@query(f"WITH {_COST_SQL} SELECT edge_id, {q6('length')} AS length, {q6('cmcs')} AS cmcs, {q6('risk_exposure')} AS risk_exposure, {q6('safety_cost')} AS safety_cost FROM c")
def edge_costs(spark, sf_dir):
    return _graph(spark, sf_dir).select("edge_id", *[r6(c).alias(c) for c in ("length", "cmcs", "risk_exposure", "safety_cost")])


@query(f"""WITH {_COST_SQL}, p AS (SELECT u, v, edge_id, length FROM c UNION ALL SELECT u, v, edge_id || 'x', length + CASE WHEN u % 2 = 0 THEN 1 ELSE -1 END FROM c)
SELECT u, v, edge_id, {q6('length')} AS length FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, edge_id) AS n FROM p) WHERE n = 1""")
def parallel_edge_choice(spark, sf_dir):
    g = _graph(spark, sf_dir).select("u", "v", "edge_id", "length")
    both = g.unionByName(g.select("u", "v", F.concat("edge_id", F.lit("x")).alias("edge_id"), (F.col("length") + F.when(F.col("u") % 2 == 0, 1).otherwise(-1)).alias("length")))
    return graph.cheapest_parallel(both, "length").select("u", "v", "edge_id", r6("length").alias("length"))


_WALK_SQL = """w AS (SELECT {start} AS n, [{start}] AS path, 0.0::DOUBLE AS len, 0.0::DOUBLE AS saf, 0.0::DOUBLE AS exp
  UNION ALL SELECT c.v, list_append(w.path, c.v), w.len + c.length, w.saf + c.safety_cost, w.exp + c.risk_exposure FROM w JOIN c ON w.n = c.u WHERE NOT list_contains(w.path, c.v) AND len(w.path) < 12)"""


@query(f"WITH RECURSIVE {_COST_SQL}, {_WALK_SQL.format(start=_START)} SELECT n AS node, {q6('min(len)')} AS dist FROM w GROUP BY 1")
def shortest_distances(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    start = g.agg(F.min("u")).first()[0]
    return graph.distances(g, start, "length").select("node", r6("dist").alias("dist"))


def _ends(g):
    """The smallest node, and the greatest that can be reached from it."""
    a = g.agg(F.min("u")).first()[0]
    return a, graph.distances(g, a, "length").where(F.col("node") != F.lit(a)).agg(F.max("node")).first()[0]


@query(f"""WITH RECURSIVE {_COST_SQL}, {_WALK_SQL.format(start=_START)}, e AS (SELECT * FROM w WHERE n = (SELECT max(n) FROM w WHERE len(path) > 1)), s AS (SELECT min(len) AS m FROM e)
SELECT {q6('min(saf)')} AS objective FROM e, s WHERE len <= 1.6 * m HAVING min(saf) IS NOT NULL""")
def rcsp_path(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    a, b = _ends(g)
    short = graph.bounded_path(g, a, b, "length", None).first()
    limit = 1.6 * short["resource"] if short else 0.0
    return graph.bounded_path(g, a, b, "safety_cost", limit).select(r6("objective").alias("objective"))


def _pairs(g):
    """Pairs from the smallest node to all others: the pairs of the route queries."""
    a = g.agg(F.min("u")).first()[0]
    return g.select(F.col("v").alias("destination")).distinct().where(F.col("destination") != a).select(F.lit(a).alias("origin"), "destination")


@query(f"""WITH RECURSIVE {_COST_SQL}, {_WALK_SQL.format(start=_START)}, s AS (SELECT n, min(len) AS m FROM w GROUP BY 1), e AS (SELECT w.* FROM w JOIN s ON s.n = w.n WHERE len <= 1.6 * round_even(m, 2) + 1e-9 AND w.n <> {_START})
SELECT n::VARCHAR AS destination, {q6('min(len)')} AS shortest, {q6('min(saf)')} AS safest, {q6('min(0.5 * len + 0.5 * saf)')} AS balanced FROM e GROUP BY 1""")
def compare_routes(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    c = routes.compare(g, _pairs(g), 1.6)
    return c.groupBy("destination").agg(*[r6(F.max(F.when(F.col("mode") == m, F.col("objective")))).alias(m) for m in ("shortest", "safest", "balanced")])


@query(f"""WITH RECURSIVE {_COST_SQL}, {_WALK_SQL.format(start=_START)}, l AS (SELECT k / 10.0::DOUBLE AS lam FROM (SELECT unnest(range(0, 11)) AS k)), e AS (SELECT * FROM w WHERE n <> {_START})
SELECT n::VARCHAR AS destination, {q6('lam')} AS lam, {q6('min(lam * len + (1 - lam) * saf)')} AS objective FROM e, l GROUP BY n, lam""")
def lambda_sweep(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    req = routes.requests(_pairs(g), [("balanced", i / 10) for i in range(11)])
    return routes.route_many(g, req).select("destination", r6("lam").alias("lam"), r6("objective").alias("objective"))


# All walks between the ends of two edges in a row, with their edges; of equal ones the first by length, then by cost.
_HOPS_SQL = """h AS (SELECT DISTINCT a.u AS o, b.v AS d FROM c a JOIN c b ON a.v = b.u WHERE a.u <> b.v),
w AS (SELECT DISTINCT u AS o, u AS n, [u] AS path, CAST([] AS VARCHAR[]) AS es, 0.0::DOUBLE AS len, 0.0::DOUBLE AS saf, 0.0::DOUBLE AS exp FROM c
  UNION ALL SELECT w.o, c.v, list_append(path, c.v), list_append(es, edge_id), len + c.length, saf + c.safety_cost, exp + c.risk_exposure FROM w JOIN c ON w.n = c.u WHERE NOT list_contains(path, c.v) AND len(path) < 10),
p AS (SELECT w.* FROM w JOIN h ON h.o = w.o AND h.d = w.n), m AS (SELECT o, n, min(len) AS m FROM p GROUP BY 1, 2), k AS (SELECT p.* FROM p JOIN m USING (o, n) WHERE len <= 1.6 * round_even(m, 2) + 1e-9),
s AS (SELECT o, n, min_by(es, (len, saf, es)) AS es, min_by(len, (len, saf, es)) AS len, min_by(exp, (len, saf, es)) AS exp FROM k GROUP BY 1, 2),
f AS (SELECT o, n, min_by(es, (saf, len, es)) AS es, min_by(len, (saf, len, es)) AS len, min_by(exp, (saf, len, es)) AS exp FROM k GROUP BY 1, 2)"""


def _hops(g):
    """Pairs of the ends of two edges in a row."""
    a, b = g.select(F.col("u").alias("origin"), F.col("v").alias("_via")), g.select(F.col("u").alias("_via"), F.col("v").alias("destination"))
    return a.join(b, "_via").where("origin <> destination").select("origin", "destination").distinct()


@query(f"""WITH RECURSIVE {_COST_SQL}, {_WALK_SQL.format(start=_START)}, l AS (SELECT k / 10.0::DOUBLE AS lam FROM (SELECT unnest(range(0, 11)) AS k)), x AS (SELECT * FROM w WHERE n <> {_START}),
b AS (SELECT n, lam, min_by(len, (lam * len + (1 - lam) * saf, len)) AS len, min_by(exp, (lam * len + (1 - lam) * saf, len)) AS exp, min(lam * len + (1 - lam) * saf) AS objective FROM x, l GROUP BY n, lam),
r AS (SELECT *, row_number() OVER (PARTITION BY n, round_even(len, 2), round_even(exp, 4) ORDER BY lam) AS i FROM b)
SELECT n::VARCHAR AS destination, {q6('lam')} AS lam, {q6('round_even(len, 2)')} AS distance, {q6('round_even(exp, 4)')} AS exposure, {q6('objective')} AS objective FROM r WHERE i = 1""")
def pareto_front(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    return routes.pareto_front(g, _pairs(g)).select("destination", *(r6(c).alias(c) for c in ("lam", "distance", "exposure", "objective")))


@query(f"""WITH RECURSIVE {_COST_SQL}, {_HOPS_SQL}, x AS (SELECT o, n, unnest(es) AS edge_id FROM s), y AS (SELECT o, n, unnest(es) AS edge_id FROM f)
SELECT edge_id, count(*) AS pairs FROM (SELECT * FROM x EXCEPT SELECT * FROM y) GROUP BY 1""")
def avoided_edges(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    return routes.avoided(routes.compare(g, _hops(g), 1.6))


@query(f"""WITH RECURSIVE {_COST_SQL}, {_HOPS_SQL}, t AS (SELECT count(*) AS n FROM h), j AS (SELECT round_even(s.len, 2) AS sl, round_even(f.len, 2) AS fl, round_even(s.exp, 4) AS sx, round_even(f.exp, 4) AS fx FROM s JOIN f USING (o, n)),
r AS (SELECT coalesce(fl / nullif(sl, 0), 0) AS r, CASE WHEN sx > 0 THEN round_even((sx - fx) / sx * 100, 2) ELSE 0 END AS c FROM j)
SELECT count(*) AS evaluated, (SELECT n FROM t) - count(*) AS skipped, count(*) FILTER (WHERE r > 1.6) AS exceeded, {q6('round_even(avg(round_even(r, 4)), 4)')} AS mean_detour, {q6('round_even(avg(c), 2)')} AS mean_reduction, {q6('median(c)')} AS median_reduction,
{q6('quantile_cont(r, 0.95)')} AS p95_detour, {q6('avg((c > 0)::INT)')} AS positive_share, true AS all_proven, count(*) >= 6 AND avg((c > 0)::INT) >= 0.8 AND median(c) > 0 AND count(*) FILTER (WHERE r > 1.6) = 0 AS stable FROM r""")
def od_batch(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    p = _hops(g)
    r = routes.od_report(routes.compare(g, p, 1.6), p.count(), 1.6)
    return r.withColumns({c: r6(c) for c in ("mean_detour", "mean_reduction", "median_reduction", "p95_detour", "positive_share")})


@query()
def hybrid_route(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    a, b = _ends(g)
    p = spark.createDataFrame([(str(a), str(b))], "origin string, destination string")
    return routes.compare(g, p, 1.6, ants=True).select("origin", "destination", "mode", "objective", "distance", "proven", "source", "gap_pct")


@query()
def search_history(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    return routes.search_history(g, routes.requests(_pairs(g), [("safest", None), ("balanced", 0.5)]))


@query()
def algorithm_evaluation(spark, sf_dir):
    g = _graph(spark, sf_dir).persist()
    return routes.certification(routes.search_history(g, routes.requests(_pairs(g), [("shortest", None), ("safest", None), ("balanced", 0.5)])))


_DEMO_SQL = "n AS (SELECT side, i // side AS r, i % side AS c FROM (SELECT side, unnest(range(0, side * side)) AS i FROM (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM customer))), s AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(a, b)), e AS (SELECT 'N' || r || '_' || c AS u, 'N' || (r + a) || '_' || (c + b) AS v, CASE WHEN a = 0 THEN 90.0 ELSE 110.0 END::DOUBLE AS length, r = 2 AND r + a = 2 AS risky, r + r + a <= 2 AS kept FROM n, s WHERE r + a BETWEEN 0 AND side - 1 AND c + b BETWEEN 0 AND side - 1), f AS (SELECT u, v, length, " + ", ".join(
    f"CASE WHEN risky THEN {a}::DOUBLE ELSE {b}::DOUBLE END{' * 5' if f == 'accident_count_norm' else ''} AS {f.replace('accident_count_norm', 'accident_count')}" for f, (a, b) in DEMO_FEATURES.items()
) + ", " + ", ".join(f"kept::INT AS {f}" for f in DEMO_SAFE) + " FROM e)"


@query(f"WITH {_DEMO_SQL} SELECT u, v, length, {q6('accident_count / 5')} AS accident_count_norm, light_density_norm, has_signal::INT AS has_signal, is_school_zone, {q6(_CMCS)} AS cmcs FROM f")
def demo_edges(spark, sf_dir):
    """The demonstration's grid with a node for each customer (rounded up to a square)."""
    side = math.ceil(math.sqrt(A.table(spark, sf_dir, "customer").count()))
    return demo_graph(spark, side)[1].select("u", "v", "length", r6("accident_count_norm").alias("accident_count_norm"), "light_density_norm", "has_signal", "is_school_zone", r6("cmcs").alias("cmcs"))


# Samples and unions
@query(f"SELECT segment_id FROM {A.segments_sql(['segment_id'])} s ORDER BY md5('42-' || segment_id), segment_id LIMIT 500")
def sample_hash(spark, sf_dir):
    s = A.segments(spark, sf_dir, ["segment_id"])
    return s.orderBy(reports.hash_order("segment_id"), "segment_id").limit(500)


@query("SELECT kind, count(*) AS n FROM (SELECT 'supplier' AS kind, s_suppkey AS k FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer) GROUP BY 1")
def union_points(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"))
    c = A.table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"))
    return s.unionByName(c).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def id_difference(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return o.join(A.table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"), "c_custkey", "left_anti")


# Models: rows only
_MODEL = ["traffic_volume_norm", "avg_speed_norm", "pedestrian_flow_norm", "illegal_parking_norm", "narrow_sidewalk_norm", "lane_count_norm"]


@query()
def edge_model_cv(spark, sf_dir):
    board, _, _ = models.train_edge_model(scored(spark, sf_dir), _MODEL)
    return board


@query()
def nested_validation(spark, sf_dir):
    return models.nested_validation(regions.region_features(A.segments(spark, sf_dir)), regions.MODEL_FEATURES)


@query()
def region_attributions(spark, sf_dir):
    """Which features the ensemble's first model rests on: mean absolute Shapley values over all regions."""
    r = regions.region_features(A.segments(spark, sf_dir))
    fitted = models.fit_regions(r, regions.MODEL_FEATURES, seeds=models.REGION_SEEDS[:1])
    return models.mean_attributions(fitted.data, fitted.final[0], fitted.keys)


@query()
def school_model(spark, sf_dir):
    d = schools.risk_dataset(*_school_layers(spark, sf_dir), crosswalk_flags={"flag": "crossing_share"}, signal_flags={"flag": "signal_share"}, lanes={"size": "lanes"})
    features = ["crosswalk_count_300m", "signal_count_300m", "nearest_crosswalk_m", "nearest_signal_m", "crossing_share", "signal_share", "lanes"]
    board, deploys = models.train_school_model(d, features, "accident_hotspot_within_radius", "district")
    return board.withColumn("deploys", F.lit(deploys))


@query()
def region_model_logo(spark, sf_dir):
    r = regions.region_features(A.segments(spark, sf_dir))
    return models.train_region_model(r, regions.MODEL_FEATURES).select(
        "district", "region_x", "region_y", "oof_risk_probability", "oof_probability_std",
        "regional_risk_probability", "regional_risk_prediction", "decision_threshold", "stable_low", "stable_high",
    )


@query()
def bootstrap_ci(spark, sf_dir):
    return metrics.bootstrap(_predictions(spark, sf_dir), "y", "p", 0.5)


@query()
def moran_permutation(spark, sf_dir):
    return evidence.moran_permutation(_cells(spark, sf_dir), "cell", _TAB, "accident_count")


@query()
def spearman_evidence(spark, sf_dir):
    return evidence.spearman_evidence(A.segments(spark, sf_dir), features=_TAB)


def _evidence_cells(spark, sf_dir):
    return regions.evidence_table(A.segments(spark, sf_dir), evidence.FEATURES).withColumn("cell", F.concat_ws("/", "district", "region_x", "region_y"))


@query()
def poisson_evidence(spark, sf_dir):
    return models.poisson_evidence(_evidence_cells(spark, sf_dir), evidence.FEATURES, "accident_count", "district")


@query()
def logistic_evidence(spark, sf_dir):
    return models.logistic_evidence(_evidence_cells(spark, sf_dir), evidence.FEATURES, "accident_label", "district")


@query()
def derived_weights(spark, sf_dir):
    """The weights that all four channels give, with each channel's score; without evidence for any risk the weights are null."""
    channels = evidence.channel_scores(_evidence_cells(spark, sf_dir))
    each = channels.groupBy("feature").pivot("channel", ["spearman", "poisson", "logistic", "moran"]).agg(F.first("score"))
    return evidence.weight_rows(channels).join(each, "feature")


# The final evaluation: predictions of accidents by traffic, held against the batch of routes.
_GATES = [
    ("ranking", "CASE WHEN roc_auc >= 0.7 AND average_precision / prevalence >= 2 THEN 'good' ELSE 'poor' END", {"roc_auc": "roc_auc", "average_precision": "average_precision", "ap_lift": "average_precision / prevalence"}),
    ("missed_risk", "CASE WHEN recall >= 0.65 THEN 'conditional' ELSE 'poor' END", {"recall": "recall", "positives": "positives", "fn": "missed"}),
    ("seed_stability", "'poor'", {"least_seed_f1": "NULL", "seed_deviation": "NULL"}),
    ("calibration", "CASE WHEN skill >= 0.1 AND recall >= 0.7 THEN 'conditional' ELSE 'poor' END", {"brier": "brier", "brier_skill": "skill", "ece": "ece"}),
    ("spatial", "'conditional'", {"least_district_f1": "least", "most_district_f1": "most"}), ("temporal", "'poor'", {"split_auc": "0", "split_brier": "1", "dummy_brier": "1"}), ("completeness", "'poor'", {"least_pass_rate": "NULL", "positives": "positives"}),
    ("routes", "CASE WHEN stable THEN 'good' ELSE 'conditional' END", {"evaluated": "evaluated", "positive_share": "positive_share", "median_reduction": "median_reduction"}), ("deployment", "'poor'", {"brier_skill": "skill", "recall": "recall"}),
]
_OD_SQL = ORACLES["od_batch"].removeprefix("WITH RECURSIVE ")
_EVAL_SQL = f"""WITH RECURSIVE od AS (WITH RECURSIVE {_OD_SQL}), ec AS ({ORACLES['ece']}), {_RANK_SQL.replace("coalesce(district, 'none') AS g", "'all' AS g")}, d AS (SELECT coalesce(district, 'none') AS g, (accident_count > 0)::INT AS y, round(traffic_volume_norm, 3) AS p FROM {A.segments_sql(_PRED)} s),
h AS (SELECT d.g, y, (p >= t)::INT AS hit FROM d, (SELECT t FROM k WHERE n = 1)), x AS (SELECT g, count(*) FILTER (WHERE y = 1 AND hit = 1) AS tp, count(*) FILTER (WHERE y = 0 AND hit = 1) AS fp, count(*) FILTER (WHERE y = 1 AND hit = 0) AS fn FROM h GROUP BY 1),
z AS (SELECT coalesce(sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE, 0) AS recall, sum(fn) AS missed, sum(tp + fn) AS positives, min(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS least, max(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS most FROM x),
o AS (SELECT m.*, z.*, ec.ece, od.* EXCLUDE (mean_detour), 1 - brier / (prevalence * (1 - prevalence)) AS skill FROM m, z, ec, od)
""" + " UNION ALL ".join(f"SELECT '{a}' AS area, '{m}' AS measure, {q6(e)} AS value, {st} AS state FROM o" for a, st, ms in _GATES for m, e in ms.items())


@query(_EVAL_SQL)
def final_evaluation(spark, sf_dir):
    p = _predictions(spark, sf_dir).select(F.col("g").alias("district"), F.col("y").alias("accident_label"), F.col("p").alias("oof_risk_probability"))
    d = evaluation.judged(evaluation.alike(p), n="n").persist()
    gates = evaluation.safety_gates(evaluation.overall(d, "n"), evaluation.by_district(d, n="n"), QUERIES["od_batch"](spark, sf_dir))
    return gates.withColumn("value", r6("value"))


# Schools, accident places and the score's inputs
@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND c_acctbal IS NOT NULL")
def school_filter(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal")
    return schools.operating(c, {"c_mktsegment": "BUILDING", "nation": "3"}, ("c_acctbal",)).select("c_custkey")


def _school_layers(spark, sf_dir):
    o, t = A.facilities(spark, sf_dir)
    named = o.withColumns({"district": F.concat(F.lit("D"), (F.col("origin") % 5).cast("string"))}).withColumnRenamed("origin", "school_id")
    spots = t.where("target % 17 = 0").select(F.col("target").alias("spot_id"), "lat", "lon", F.expr("cast(2012 + target % 13 as int)").alias("search_year"), F.expr("concat('spot ', cast(target as string))").alias("spot_nm"),
        F.expr("target % 9").alias("occrrnc_cnt"), F.expr("target % 11").alias("caslt_cnt"), F.expr("case when target % 5 = 0 then target % 3 end").alias("dth_dnv_cnt"))
    return named, t.withColumnRenamed("target", "crosswalk_id"), t.where("target % 2 = 0").withColumnRenamed("target", "signal_id"), spots


_WITHIN = "count(*) FILTER (WHERE d <= {r}{more}) AS {name}_count_{r}m"


@query(f"""WITH {_PAIRS_SQL} SELECT origin AS school_id, 'D' || origin % 5 AS district, {", ".join(_WITHIN.format(r=r, more="", name="crosswalk") for r in (100, 300, 500))},
{", ".join(_WITHIN.format(r=r, more=" AND target % 2 = 0", name="signal") for r in (100, 300, 500))},
{q6("min(d)")} AS nearest_crosswalk_m, {q6("min(d) FILTER (WHERE target % 2 = 0)")} AS nearest_signal_m,
{q6("coalesce(count(*) FILTER (WHERE d <= 300 AND upper(flag) = 'Y') / nullif(count(*) FILTER (WHERE d <= 300), 0)::DOUBLE, 0)")} AS crossing_share,
{q6("coalesce(count(*) FILTER (WHERE d <= 300 AND target % 2 = 0 AND upper(flag) = 'Y') / nullif(count(*) FILTER (WHERE d <= 300 AND target % 2 = 0), 0)::DOUBLE, 0)")} AS signal_share,
{q6("coalesce(avg(size) FILTER (WHERE d <= 300), 0)")} AS lanes, CASE origin % 5 WHEN 1 THEN 11 WHEN 3 THEN 7 ELSE 0 END::BIGINT AS academy_count_district, 0::BIGINT AS illegal_parking_count_district,
{q6("min(d) FILTER (WHERE target % 17 = 0)")} AS nearest_hotspot_m, CAST(2012 + arg_min(target, (d, target)) FILTER (WHERE target % 17 = 0) % 13 AS INT) AS nearest_hotspot_year,
'spot ' || arg_min(target, (d, target)) FILTER (WHERE target % 17 = 0) AS nearest_hotspot_name, CAST(min(d) FILTER (WHERE target % 17 = 0) <= 300 AS INT) AS accident_hotspot_within_radius, 300.0::DOUBLE AS label_radius_m FROM pr GROUP BY origin""")
def school_risk(spark, sf_dir):
    academies = spark.createDataFrame([("D1", 11), ("D3", 7)], "district string, count long")
    df = schools.risk_dataset(*_school_layers(spark, sf_dir), academies=academies, crosswalk_flags={"flag": "crossing_share"}, signal_flags={"flag": "signal_share"}, lanes={"size": "lanes"})
    floats = [n for n, t in df.dtypes if t == "double" and n not in ("lat", "lon", "label_radius_m")]
    return df.withColumns({c: r6(c) for c in floats}).drop("lat", "lon")


@query(f"SELECT district, count(*) AS count, CAST(sum(is_school_zone) AS BIGINT) AS sum FROM {A.segments_sql(['district', 'is_school_zone'])} s WHERE district IS NOT NULL GROUP BY 1")
def district_distribution(spark, sf_dir):
    return schools.district_distribution(A.segments(spark, sf_dir, ["district", "is_school_zone"]), "is_school_zone")


_SPOT_CLUSTERS = f"""{A.FACILITIES_SQL}, s AS (SELECT target AS id, lat, lon, 2012 + target % 13 AS y, target % 9 AS a, target % 11 AS c, CASE WHEN target % 5 = 0 THEN target % 3 END AS x FROM t WHERE target % 17 = 0),
l AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, power(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * power(sin((radians(q.lon) - radians(p.lon)) / 2), 2) AS h FROM s p JOIN s q ON p.id <> q.id) WHERE {_HAV} <= 1000),
reach AS (SELECT id AS f, id AS g FROM s UNION SELECT r.f, l.b FROM reach r JOIN l ON r.g = l.a), k AS (SELECT f AS id, min(g) AS cluster FROM reach GROUP BY 1),
m AS (SELECT cluster, count(DISTINCT y) AS distinct_years, CAST(min(y) AS INT) AS first_year, CAST(max(y) AS INT) AS last_year, count(*) AS hotspot_records, CAST(coalesce(sum(a), 0) AS BIGINT) AS accident_count, CAST(coalesce(sum(c), 0) AS BIGINT) AS casualty_count,
  CAST(coalesce(sum(x), 0) AS BIGINT) AS death_count, avg(lat) AS latitude, avg(lon) AS longitude FROM k JOIN s USING (id) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_SPOT_CLUSTERS} SELECT * EXCLUDE (latitude, longitude), {q6('latitude')} AS latitude, {q6('longitude')} AS longitude FROM m")
def accident_clusters(spark, sf_dir):
    spots = _school_layers(spark, sf_dir)[3]
    df = schools.cluster_summary(spots.join(spatial.clusters(spots, "spot_id", 1000.0), "spot_id"))
    return df.withColumns({c: r6(c) for c in ("latitude", "longitude")})


@query(f"""WITH RECURSIVE {_SPOT_CLUSTERS}, w AS (SELECT * FROM m ORDER BY death_count DESC, distinct_years DESC, accident_count DESC, casualty_count DESC, cluster LIMIT 1),
z AS (SELECT origin, {_HAV} AS d FROM (SELECT origin, power(sin((radians(lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * power(sin((radians(lon) - radians(longitude)) / 2), 2) AS h FROM o, w))
SELECT k.id AS spot_id, cluster, death_count, accident_count, distinct_years, (SELECT arg_min(origin, (d, origin)) FROM z) AS nearest_school, (SELECT round(min(d), 1)::DOUBLE FROM z) AS nearest_school_distance_m FROM k JOIN w USING (cluster)""")
def repeated_accidents(spark, sf_dir):
    named, _, _, spots = _school_layers(spark, sf_dir)
    return schools.repeated_place(spots, named, radius=1000.0).select("spot_id", "cluster", "death_count", "accident_count", "distinct_years", "nearest_school", "nearest_school_distance_m")


_RAW = {
    "traffic_volume_proxy": "traffic_volume_norm * 3 - 0.5", "avg_speed_kph": "length_m / 2", "narrow_sidewalk_proxy": "narrow_sidewalk_norm * 2", "slope_proxy": "slope_norm - 0.25",
    "academy_density": "crosswalk_count * 5", "illegal_parking": "bus_stop_count * 3", "lane_count": "lane_count_norm * 12 - 1", "lit_tag_score": "light_density_norm",
}
_LOGS = {"academy_density": "academy_density_norm", "illegal_parking": "illegal_parking_norm", "bus_stop_count": "bus_stop_nearby_norm", "crosswalk_count": "crosswalk_count_norm", "signal_count": "signal_count_norm", "speed_bump_count": "speed_bump_count_norm", "accident_count": "accident_count_norm", "streetlight_count": "lamp"}
_SCALE = ", ".join(f"coalesce((ln(1 + {c}) - min(ln(1 + {c})) OVER ()) / nullif(max(ln(1 + {c})) OVER () - min(ln(1 + {c})) OVER (), 0), 0) AS {n}" for c, n in _LOGS.items())
_PLAIN = {
    "traffic_volume_norm": "greatest(least(traffic_volume_proxy, 1), 0)", "avg_speed_norm": "greatest(least(avg_speed_kph / 100, 1), 0)", "narrow_sidewalk_norm": "greatest(least(narrow_sidewalk_proxy, 1), 0)",
    "slope_norm": "greatest(least(slope_proxy, 1), 0)", "lane_count_norm": "greatest(least(lane_count, 6), 1) / 6", "light_density_norm": "CASE WHEN lit_tag_score IS NOT NULL THEN greatest(lit_tag_score, lamp) END",
    "pedestrian_flow_norm": "least(0.45 * academy_density_norm + 0.35 * bus_stop_nearby_norm + 0.20 * is_school_zone, 1)",
} | {n: n for n in _LOGS.values() if n != "lamp"}
_SEGMENT_INPUTS = ["segment_id", "is_school_zone", "school_zone_cctv_count", "crosswalk_count", "signal_count", "speed_bump_count", "bus_stop_count", "accident_count", "streetlight_count", "length_m", "traffic_volume_norm", "narrow_sidewalk_norm", "slope_norm", "lane_count_norm", "light_density_norm"]
_RAW_KEPT = [c for c in _SEGMENT_INPUTS if c not in ("length_m", "traffic_volume_norm", "narrow_sidewalk_norm", "slope_norm", "lane_count_norm", "light_density_norm")]


@query(f"""WITH r AS (SELECT {", ".join(_RAW_KEPT)}, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _RAW.items())} FROM {A.segments_sql(_SEGMENT_INPUTS)} s), n AS (SELECT *, {_SCALE} FROM r)
SELECT segment_id, CAST(crosswalk_count > 0 AS INT) AS has_crosswalk, CAST(signal_count > 0 AS INT) AS has_signal, CAST(speed_bump_count > 0 AS INT) AS has_speed_bump, CAST(school_zone_cctv_count > 0 AS INT) AS has_cctv,
{", ".join(f"{q6(e)} AS {n}" for n, e in _PLAIN.items())} FROM n""")
def segment_inputs(spark, sf_dir):
    raw = A.segments(spark, sf_dir, _SEGMENT_INPUTS).select(*_RAW_KEPT, *[F.expr(e).cast("double").alias(n) for n, e in _RAW.items()])
    return segments.normalised(raw).select("segment_id", *segments.FLAGS.values(), *[r6(n).alias(n) for n in _PLAIN])


@query(f"WITH {_COST_SQL} SELECT count(*) AS directed_edges, count(DISTINCT edge_id) AS unique_segments, {q6('avg(cmcs)')} AS mean, count(*) FILTER (WHERE cmcs >= 0.5) AS high_risk_edge_count FROM c")
def segment_counts(spark, sf_dir):
    df = segments.segment_counts(_graph(spark, sf_dir).withColumn("segment_id", F.col("edge_id")), "cmcs", 0.5)
    return df.withColumn("mean", r6("mean"))


@query(f"WITH {_COST_SQL} SELECT a.edge_id FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE b.u % 3 = 0 AND ((a.u = b.v AND a.v = b.u) OR (a.u = b.u AND a.v = b.v)))")
def route_edges(spark, sf_dir):
    g = _graph(spark, sf_dir).select("u", "v", "edge_id").withColumn("key", F.lit(0))
    # The path names its edges backwards.
    return routes.route_edges(g, g.where("u % 3 = 0").select(F.col("v").alias("u"), F.col("u").alias("v"), "key")).select("edge_id")


@query()
def fitted_weights(spark, sf_dir):
    got = models.fit_weights(A.segments(spark, sf_dir, [*models.WEIGHT_COLUMNS, "accident_count"]), "accident_count")
    return spark.createDataFrame(list(got.items()), "feature string, weight double")
