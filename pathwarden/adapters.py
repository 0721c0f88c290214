"""The test tables as the inputs that the operators expect; all integer arithmetic, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road classes in the order of their share columns; "other" takes all else.
HIGHWAYS = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "residential", "unclassified", "living_street", "service", "pedestrian", "footway", "path", "steps", "track", "other",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(x: Column) -> Column:
    """``round(x)`` to a whole number, half away from zero, without the decimal that Spark's makes of every value."""
    near = F.rint(x)
    return near + F.when((x > 0) & (x - near == 0.5), 1.0).when((x < 0) & (x - near == -0.5), -1.0).otherwise(0.0)


_SEGMENT_FIELDS = {
    "segment_id": "concat('S', cast(k as string))",
    "edge_id": "concat('E', cast(k as string))",
    "district": "case when r = 4 then null else concat('D', cast(r as string)) end",
    "highway": "element_at(split('{hw},x,y', ','), cast(k % 22 as int) + 1)".replace("{hw}", ",".join(HIGHWAYS)),
    "center_x": "cast(1000000 + (c * 37) % 20000 as double)",
    "center_y": "cast(1800000 + (k * 101) % 20000 as double)",
    "length_m": "cast(50 + k % 450 as double)",
    "traffic_volume_norm": "d / (10D * n)",
    "avg_speed_norm": "q / (50D * n)",
    "narrow_sidewalk_norm": "(k % 5) / 4D",
    "slope_norm": "(c % 16) / 15D",
    "is_alley": "cast(k % 7 = 0 as int)",
    "pedestrian_flow_norm": "t / (8D * n)",
    "academy_density_norm": "least(n, 7) / 7D",
    "bus_stop_nearby_norm": "(k % 11) / 10D",
    "illegal_parking_norm": "nr / cast(n as double)",
    "light_density_norm": "case when k % 13 = 0 then null else (c % 9) / 8D end",
    "has_crosswalk": "cast(n >= 4 as int)",
    "has_signal": "cast(na > 0 as int)",
    "lane_count_norm": "(1 + k % 6) / 6D",
    "has_speed_bump": "cast(k % 4 = 0 as int)",
    "has_cctv": "cast(c % 6 = 0 as int)",
    "is_school_zone": "cast(c % 10 = 0 as int)",
    "accident_count": "t8",
    "crosswalk_count": "n",
    "signal_count": "na",
    "speed_bump_count": "k % 3",
    "bus_stop_count": "nr",
    "streetlight_count": "c % 9",
    "school_zone_cctv_count": "k % 2",
}


def segments(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """A road segment per order that has lines; ``columns`` prunes what is read and computed."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("n"),
        F.sum(whole(F.col("l_discount") * 100).cast("long")).alias("d"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(whole(F.col("l_tax") * 100).cast("long")).alias("t"),
        F.count_if(whole(F.col("l_tax") * 100) >= 8).alias("t8"),
        F.count_if(F.col("l_returnflag") == "R").alias("nr"),
        F.count_if(F.col("l_returnflag") == "A").alias("na"),
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r"))
    # Nations are 25 rows by definition of the table.
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    joined = lines.join(orders, "k").join(customer, F.col("c") == F.col("c_custkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in _SEGMENT_FIELDS.items() if columns is None or n in columns])


def segments_sql(columns: list[str] | None = None) -> str:
    """The same for DuckDB, as a subquery."""
    duck = {n: e for n, e in _SEGMENT_FIELDS.items() if columns is None or n in columns}
    fields = ", ".join(f"{e.replace('0D', '0.0::DOUBLE').replace('4D', '4.0::DOUBLE').replace('5D', '5.0::DOUBLE').replace('8D', '8.0::DOUBLE').replace('7D', '7.0::DOUBLE').replace('6D', '6.0::DOUBLE').replace('element_at(split', 'list_extract(string_split')} AS {n}" for n, e in duck.items())
    return f"""(SELECT {fields} FROM (
      SELECT l_orderkey AS k, count(*) AS n, sum(cast(round(l_discount * 100) AS BIGINT)) AS d, sum(cast(l_quantity AS BIGINT)) AS q,
        sum(cast(round(l_tax * 100) AS BIGINT)) AS t, count(*) FILTER (WHERE round(l_tax * 100) >= 8) AS t8,
        count(*) FILTER (WHERE l_returnflag = 'R') AS nr, count(*) FILTER (WHERE l_returnflag = 'A') AS na
      FROM lineitem GROUP BY l_orderkey) l
      JOIN (SELECT o_orderkey, o_custkey AS c FROM orders) o ON o.o_orderkey = l.k
      JOIN customer ON c = c_custkey JOIN (SELECT n_nationkey, n_regionkey AS r FROM nation) nn ON n_nationkey = c_nationkey)"""


_LAT = "(case when event_id % 41 = 0 then 37.5 else 36.18 + (event_id * 7919 % 3701) / 10000D end)"
_LON = "(127.29 + (event_id * 104729 % 3301) / 10000D)"
_POINT_FIELDS = {
    "sn": "case when event_id % 61 = 0 then null else concat('P', cast(event_id % 7001 as string)) end",
    "latitude": f"case when event_id % 97 = 0 then null when event_id % 89 = 0 then 'n/a' when event_id % 50 = 0 then cast({_LON} as string) else cast({_LAT} as string) end",
    "longitude": f"case when event_id % 50 = 0 then cast({_LAT} as string) else cast({_LON} as string) end",
    "name": "concat('  ', event_type, '   ', cast(event_id % 13 as string), ' ')",
    "occrrnc_cnt": "case when event_id % 53 = 0 then 'x' else cast(event_id % 37 - 1 as string) end",
    "referenceDate": "case when event_id % 71 = 0 then 'soon' else cast(cast(ts as date) as string) end",
    "_row_ord": "event_id",
}


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as text, with swapped, missing, unparsable and far coordinates."""
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in _POINT_FIELDS.items()])


def raw_points_sql() -> str:
    fields = ", ".join(f"{e.replace('10000D', '10000.0::DOUBLE').replace('as string', 'as VARCHAR')} AS {n}" for n, e in _POINT_FIELDS.items())
    return f"(SELECT {fields} FROM events)"


def facilities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(origins, targets): coordinates in degrees of suppliers and events."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("origin"), F.expr("36.18 + (s_suppkey * 7919 % 3701) / 10000D").alias("lat"), F.expr("127.29 + (s_suppkey * 104729 % 3301) / 10000D").alias("lon")
    )
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("target"), F.expr("36.18 + (event_id * 6007 % 3701) / 10000D").alias("lat"), F.expr("127.29 + (event_id * 15485863 % 3301) / 10000D").alias("lon"),
        F.expr("case event_type when 'click' then 'Y' else 'n' end").alias("flag"), F.expr("cast(event_id % 30 as double)").alias("size"),
    )
    return s, e


FACILITIES_SQL = """
o AS (SELECT s_suppkey AS origin, 36.18 + (s_suppkey * 7919 % 3701) / 10000.0::DOUBLE AS lat, 127.29 + (s_suppkey * 104729 % 3301) / 10000.0::DOUBLE AS lon FROM supplier),
t AS (SELECT event_id AS target, 36.18 + (event_id * 6007 % 3701) / 10000.0::DOUBLE AS lat, 127.29 + (event_id * 15485863 % 3301) / 10000.0::DOUBLE AS lon,
  CASE event_type WHEN 'click' THEN 'Y' ELSE 'n' END AS flag, CAST(event_id % 30 AS DOUBLE) AS size FROM events)"""


def graph(spark: SparkSession, sf_dir: str, out_degree: int = 3) -> DataFrame:
    """Directed edges between nations: each nation's ``out_degree`` greatest flows of goods."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("u"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", whole(F.col("l_discount") * 100).cast("long").alias("d"))
    flows = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("u", "v").agg(F.count("*").alias("n"), F.sum("d").alias("d")).where("u <> v")
    )
    from pyspark.sql import Window

    top = flows.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))).where(F.col("k") <= out_degree)
    return top.select(
        "u", "v", F.concat(F.lit("E"), F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string")).alias("edge_id"),
        F.col("n").cast("double").alias("length"), (F.col("d") / (F.lit(10.0) * F.col("n"))).alias("cmcs"),
    )


GRAPH_SQL = """
g AS (SELECT u, v, 'E' || u || '-' || v AS edge_id, CAST(n AS DOUBLE) AS length, d / (10.0::DOUBLE * n) AS cmcs FROM (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS k FROM (
    SELECT s_nationkey AS u, c_nationkey AS v, count(*) AS n, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)) WHERE k <= 3)"""
