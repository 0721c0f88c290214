"""Paged JSON and XML services, a geocoder's cache, and the demo graph."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Given a URL, its body. The default goes to the network; tests give their own.
Fetch = Callable[[str], str]


def http_get(url: str, timeout: float = 30.0) -> str:
    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8")


def payload(body: str) -> tuple[list[dict], int]:
    """(items, total) of a response; a single item is a list of one, and a bad result code fails."""
    doc = json.loads(body)
    doc = doc.get("response", doc)
    head = doc.get("header", doc)
    code = str(head.get("resultCode", "00"))
    if code not in ("00", "0", "OK"):
        raise ValueError(f"the service answered {code}: {head.get('resultMsg', '')}")
    inner = doc.get("body", doc)
    items = inner.get("items", [])
    if isinstance(items, dict):
        items = items.get("item", [])
    items = [items] if isinstance(items, dict) else list(items or [])
    return items, int(inner.get("totalCount", len(items)) or 0)


def pages(fetch: Fetch, url: str, params: dict, size: int = 1000, page: str = "pageNo", rows: str = "numOfRows") -> Iterator[dict]:
    """All items of a paged service: stops at an empty page or when the total is there."""
    n, got = 1, 0
    while True:
        items, total = payload(fetch(f"{url}?{urlencode(params | {page: n, rows: size})}"))
        yield from items
        got += len(items)
        if not items or got >= total:
            return
        n += 1


class _Page(InputPartition):
    def __init__(self, value: dict):
        self.value = value


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        o = self.options
        return [_Page({o["partition"]: v}) for v in o["values"].split(",")] if o.get("partition") else [_Page({})]

    def read(self, partition):
        o = self.options
        fixed = json.loads(o.get("params", "{}"))
        for item in pages(http_get, o["url"], fixed | partition.value, int(o.get("pagesize", 1000))):
            yield (json.dumps(item | partition.value, ensure_ascii=False),)


class PagedSource(DataSource):
    """``spark.read.format("paged")``: options url, params (JSON), partition and values (one partition a value)."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "item string"

    def reader(self, schema):
        return PagedReader(self.options)


def fetch_rows(spark: SparkSession, fetch: Fetch, url: str, params: dict, schema: str, by: dict[str, list] | None = None) -> DataFrame:
    """The items of a service in columns; ``by`` is one parameter and its values (a year and the years), added as ``search_<name>``."""
    texts = []
    for name, values in (by or {"": [None]}).items():
        for v in values:
            texts += [(json.dumps(x | ({f"search_{name}": v} if name else {}), ensure_ascii=False),) for x in pages(fetch, url, params | ({name: v} if name else {}))]
    return spark.createDataFrame(texts, "item string").select(F.from_json("item", schema).alias("i")).select("i.*")


def fetch_all(jobs: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames, failures): a dataset that fails doesn't stop the others."""
    out, bad = {}, {}
    for name, job in jobs.items():
        try:
            out[name] = job()
        except Exception as e:  # noqa: BLE001
            bad[name] = str(e)
    return out, bad


def collect(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], folder: str, refresh: bool = False) -> tuple[dict[str, int], dict[str, str]]:
    """(rows, failures) by dataset of ``folder``: those stored there are counted, others (all, with ``refresh``) are fetched and stored first.

    A dataset whose fetch fails keeps what was stored before, and counts that.
    """
    counts, bad = {}, {}
    for name, job in jobs.items():
        path = f"{folder.rstrip('/')}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if refresh or not fs.exists(done):
            got, why = fetch_all({name: job})
            if not why:
                # Stored beside first: an overwrite that fails half-way would lose what was there.
                _, why = fetch_all({name: lambda df=got[name], to=f"{path}.new": df.write.mode("overwrite").parquet(to)})
            if not why:
                old, new = done.getParent(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
                fs.delete(old, True)
                fs.rename(new, old)
            bad |= why
        counts[name] = spark.read.parquet(path).count() if fs.exists(done) else 0
    return counts, bad


def xml_items(bodies: DataFrame, schema: str) -> DataFrame:
    """Items of XML bodies (column body): ``schema`` is that of one item."""
    whole = F.from_xml("body", f"body struct<items:struct<item:array<struct<{schema}>>>>")
    return bodies.select(F.explode(whole["body"]["items"]["item"]).alias("i")).select("i.*")


def geocode(addresses: DataFrame, cache: DataFrame, lookup: Callable[[str], tuple[float, float] | None] | None = None, column: str = "address") -> tuple[DataFrame, DataFrame]:
    """(addresses with lat and lon, cache with the new answers); failures are remembered as null; without ``lookup`` only the cache is used."""
    new = cache.sparkSession.createDataFrame([], cache.schema)
    if lookup is not None:

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = [lookup(a) or (None, None) for a in f["address"]]
                yield pd.DataFrame({"address": f["address"], "lat": [g[0] for g in got], "lon": [g[1] for g in got]}).astype({"lat": float, "lon": float})

        missing = addresses.select(F.col(column).alias("address")).where("address is not null").distinct().join(cache, "address", "left_anti")
        new = missing.mapInPandas(ask, "address string, lat double, lon double").persist()
    whole = cache.unionByName(new.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("lat", "lon")}))
    return addresses.join(whole.withColumnRenamed("address", column), column, "left"), whole


# The demonstration's features on the risky row and elsewhere.
DEMO_FEATURES = {
    "accident_count_norm": (0.90, 0.08), "traffic_volume_norm": (0.85, 0.18), "avg_speed_norm": (0.80, 0.20), "narrow_sidewalk_norm": (0.75, 0.18), "slope_norm": (0.12, 0.12), "is_alley": (1, 0),
    "pedestrian_flow_norm": (0.70, 0.22), "academy_density_norm": (0.82, 0.15), "bus_stop_nearby_norm": (0.65, 0.10), "illegal_parking_norm": (0.88, 0.10), "light_density_norm": (0.28, 0.88),
    "has_crosswalk": (0, 1), "has_signal": (0, 1), "lane_count_norm": (0.80, 0.15),
}
DEMO_SAFE = ("has_speed_bump", "has_cctv", "is_school_zone")


def demo_graph(spark: SparkSession, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a grid with both directions, the score's features and the score; edges along row 2 are risky, those up to between rows 1 and 2 well kept."""
    from pathwarden.operators.scoring import score

    n = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    name = lambda r, c: F.concat(F.lit("N"), r.cast("string"), F.lit("_"), c.cast("string"))
    nodes = n.select(name(F.col("row"), F.col("col")).alias("node"), (F.lit(127.38) + F.col("col") * 0.001).alias("x"), (F.lit(36.35) + F.col("row") * 0.001).alias("y"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    e = n.select("row", "col", steps).select("row", "col", (F.col("row") + F.col("s.dr")).alias("r2"), (F.col("col") + F.col("s.dc")).alias("c2")).where(F.col("r2").between(0, size - 1) & F.col("c2").between(0, size - 1))
    risky, kept = (F.col("row") == 2) & (F.col("r2") == 2), (F.col("row") + F.col("r2")) / 2 <= 1.25
    u, v = name(F.col("row"), F.col("col")), name(F.col("r2"), F.col("c2"))
    length = F.when(F.col("row") == F.col("r2"), 90.0).otherwise(110.0)
    features = [F.when(risky, a).otherwise(b).alias(f) for f, (a, b) in DEMO_FEATURES.items()] + [kept.cast("int").alias(f) for f in DEMO_SAFE]
    edges = e.select(u.alias("u"), v.alias("v"), F.concat_ws("-", F.lit("E"), u, v, F.lit("0")).alias("edge_id"), length.alias("length"), length.alias("length_m"), *features)
    return nodes, score(edges).drop("cmcs_weight_source")
