"""Places and running sums against plain Python."""

import random

import numpy as np

from pyspark.sql import functions as F

from pathwarden.operators import ordering


def test_places_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), k) for k in range(500)] + [("lone", 5, 999)]
    df = spark.createDataFrame(rows, "g string, x long, tag long").repartition(7)
    got = ordering.numbered(df, [F.col("x").asc_nulls_first(), "tag"], "place", by=["g"], parts=5).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            want[r[2]] = k
    assert {r["tag"]: r["place"] for r in got} == want and len(got) == len(rows)
    assert ordering.numbered(df.limit(0), ["x"], "place", by=["g"]).count() == 0


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(100), rng.choice([None, 1, 2])) for k in rng.sample(range(5000), 700)]
    got = ordering.running(spark.createDataFrame(rows, "k long, v long, w long").repartition(6), [F.desc("k")], {"sv": "v", "sw": "w"}, parts=9).collect()
    sv = sw = 0
    want = {}
    for k, v, w in sorted(rows, reverse=True):
        sv, sw = sv + v, sw + (w or 0)
        want[k] = (sv, sw)
    assert {r["k"]: (r["sv"], r["sw"]) for r in got} == want
    assert ordering.running(spark.createDataFrame([], "k long, v long"), ["k"], {"s": "v"}).count() == 0


def test_running_sums_by_group_either_way(spark):
    rng = random.Random(6)
    rows = [(g, k, rng.randrange(9)) for g in ("a", "b", None) for k in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    want, got = {}, {}
    for g in ("a", "b", None):
        s = 0
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            s += v
            want[g, k] = s
    for at_once in (0, 1_000_000):
        got = {(r["g"], r["k"]): r["s"] for r in ordering.running(df, ["k"], {"s": "v"}, by=["g"], parts=6, at_once=at_once).collect()}
        assert got == want


def test_exact_quantiles_either_way(spark):
    rng = np.random.default_rng(7)
    n = 5000
    columns = {
        "spread": rng.normal(size=n), "tied": rng.integers(0, 3, n).astype(float), "heavy": np.exp(rng.normal(size=n) * 6), "mostly": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)),
        "few": np.where(rng.random(n) < 0.999, np.nan, 1.5), "one": np.full(n, 2.0),
    }
    rows = [tuple(None if np.isnan(v[i]) else float(v[i]) for v in columns.values()) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none"])).repartition(4).persist()
    ps = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    for at_once in (60, 1_000_000):
        got = ordering.quantiles(df, {c: (F.col(c), ps) for c in [*columns, "none"]}, at_once=at_once)
        assert got.pop("none") is None
        for c, v in columns.items():
            assert np.allclose(got[c], np.quantile(v[~np.isnan(v)], ps), rtol=1e-12, atol=1e-12), c
    assert ordering.quantiles(df.limit(0), {"x": (F.col("spread"), ps)}) == {"x": None}


def test_input_is_computed_once_however_many_passes(spark):
    from pathwarden.operators import evidence, quality, regions, scoring

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    def told(df):
        return df.mapInPandas(counted, df.schema)

    plain = spark.range(500).select(F.concat(F.lit("S"), "id").alias("segment_id"), F.lit("D").alias("district"), (F.col("id") % 40 * 100.0).alias("center_x"), (F.col("id") * 7 % 90 * 100.0).alias("center_y"),
        (F.col("id") % 50 + 1.0).alias("length_m"), (F.col("id") % 3).alias("accident_count"), (F.col("id") % 97).alias("crosswalk_count"), (F.col("id") % 89 / 89.0).alias("cmcs"), (F.col("id") % 2).alias("has_crosswalk"), (F.col("id") % 5 == 0).cast("int").alias("has_signal"),
        *((F.col("id") % (11 + i) / 20.0).alias(f) for i, f in enumerate(f for f in [*evidence.FEATURES, "light_density_norm"] if not f.endswith("deficit"))))
    for work in (
        lambda df: ordering.quantiles(df, {"a": (F.col("cmcs"), [0.1, 0.7]), "b": (F.col("length_m"), [0.5])}, rows=500, at_once=20),
        lambda df: scoring.risk_classes(scoring.risk_score(df)[0]).count(), lambda df: quality.winsorize(df, ["crosswalk_count"])[0].count(), lambda df: quality.prepare_for_analysis(df)[0].count(),
        lambda df: (lambda cells: cells.count() + cells.distinct().count())(regions.evidence_table(df, evidence.FEATURES)),
    ):
        seen.value = 0
        cells = work(told(plain))
        assert cells and seen.value == 500
