"""Cleaning of point records, imputation and quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pathwarden.functions.semantics import bounded, clean_text, clip, first_existing, is_close, number, to_double
from pathwarden.operators.ordering import AT_ONCE, quantiles
from pathwarden.storage import stored

# The city's bounds in degrees, inclusive.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 36.18, 36.55, 127.29, 127.62


@dataclass(frozen=True)
class PointSchema:
    """Which columns of a source hold what; the first alias that exists is used."""

    name: str
    latitude: tuple[str, ...] = ("latitude", "LATITUDE", "위도", "lat")
    longitude: tuple[str, ...] = ("longitude", "LONGITUDE", "경도", "lon")
    ids: tuple[str, ...] = ("id", "sn")
    dates: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    dedupe: tuple[str, ...] = ()
    nonnegative: tuple[str, ...] = ()
    required: tuple[str, ...] = field(default=())


# The column names of three public sources.
SCHEMAS = {
    "speed_bump": PointSchema(
        "speed_bump", latitude=("LATITUDE", "latitude", "위도", "lat"), longitude=("LONGITUDE", "longitude", "경도", "lon"), ids=("SDHP_SN", "sno", "id", "과속방지턱관리번호"),
        dates=("DATA_STD_DE", "데이터기준일자", "referenceDate"), numeric=("LATITUDE", "LONGITUDE", "height", "width", "length"), text=("LOCPLC", "address", "소재지도로명주소"), dedupe=("SDHP_SN",), nonnegative=("height", "width", "length"),
    ),
    "school_zone": PointSchema(
        "school_zone", ids=("sn", "id", "관리번호", "kidSafeZoneId"), dates=("referenceDate", "데이터기준일자", "regDate"), numeric=("latitude", "longitude"), text=("name", "address", "roadAddress", "cctv"), dedupe=("sn",),
    ),
    "traffic_accident": PointSchema(
        "traffic_accident", latitude=("la_crd", "latitude", "위도", "lat"), longitude=("lo_crd", "longitude", "경도", "lon"), ids=("afos_fid", "accidentId", "spot_cd", "id"),
        dates=("occrrnc_dt", "accidentDate", "searchYear", "search_year", "searchYearCd"), numeric=("la_crd", "lo_crd", "occrrnc_cnt", "caslt_cnt", "dth_dnv_cnt", "se_dnv_cnt", "sl_dnv_cnt", "wnd_dnv_cnt"),
        text=("spot_nm", "sido_sgg_nm"), dedupe=("afos_fid",), nonnegative=("occrrnc_cnt", "caslt_cnt", "dth_dnv_cnt", "se_dnv_cnt", "sl_dnv_cnt", "wnd_dnv_cnt"),
    ),
}


def in_city(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX), F.lit(False))


def swapped(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(LON_MIN, LON_MAX) & lon.between(LAT_MIN, LAT_MAX), F.lit(False))


def _floored(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def _spreads(n: int, lo: float, hi: float, q: list[float] | None) -> bool:
    """Whether a column has 20 values, and neither its values nor its quantiles are close to each other."""
    close = lambda a, b: abs(a - b) <= 1e-8 + 1e-5 * abs(b)
    return n >= 20 and not close(lo, hi) and not close(*q)


def winsor_bounds(df: DataFrame, columns: list[str], lower: float = 0.005, upper: float = 0.995, more: Sequence[Column] = (), quarters: Sequence[str] = ()) -> tuple[dict[str, tuple[float, float]], Row | None, dict[str, list[float]]]:
    """The clip bounds of each column that has 20 values and spreads; the one row of the aggregates ``more``, made in the same pass; and the quartiles of ``quarters``.

    Columns of ``quarters`` that are in ``columns`` too are taken without negatives.
    """
    x = {c: _floored(F.col(c)) for c in columns}
    aggs = [f.alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count(x[c])), ("l", F.min(x[c])), ("h", F.max(x[c])))]
    wanted = {c: (x[c], [lower, upper]) for c in columns} | {f"{c}/4": (x.get(c, F.col(c)), [0.25, 0.75]) for c in quarters}
    if not aggs and not more and not wanted:
        return {}, None, {}
    rows = df.count()
    together = rows <= AT_ONCE
    if together:
        aggs += [F.percentile(e, ps).alias(f"_q{i}") for i, (e, ps) in enumerate(wanted.values())]
    r = df.agg(*aggs, *more).first() if aggs or more else None
    q = {name: r[f"_q{i}"] for i, name in enumerate(wanted)} if together else quantiles(df, wanted, rows)
    return {c: tuple(q[c]) for i, c in enumerate(columns) if q[c] and _spreads(r[f"_n{i}"], r[f"_l{i}"], r[f"_h{i}"], q[c])}, r, {c: q[f"{c}/4"] for c in quarters}


def _clipped(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), bounded(F.col(c), *(max(b, 0.0) for b in bounds.get(c, (0.0, float("inf")))))) for c in columns})


def winsorize(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """``columns`` without negatives and clipped to their 0.5 % and 99.5 % quantiles; ``df`` is stored, since bounds and rows take several passes."""
    df, _ = stored(df)
    bounds = winsor_bounds(df, columns)[0]
    return _clipped(df, columns, bounds), {c: (round(a, 6), round(b, 6)) for c, (a, b) in bounds.items()}


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``; null keys are equal to each other.  Rows of a key meet one by one, before the shuffle too."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order)).alias("_kept")).select("_kept.*")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_kept")).select("_kept.*")


def parse_date(c: Column) -> Column:
    """A timestamp of a date text; four digits are the first day of that year."""
    t = c.cast("string")
    return F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")))).otherwise(F.try_to_timestamp(t))


def clean_points(df: DataFrame, name: str, schema: PointSchema | None = None, collected_at: datetime | None = None, drop_invalid: bool = True, order: str = "_row_ord") -> tuple[DataFrame, dict]:
    """Standard columns beside the raw ones, without repeated and (by default) far rows; and a report.

    Rows are numbered by ``order``; without that column, in the order in which Spark numbers them.
    """
    schema = schema or SCHEMAS.get(name, PointSchema(name))
    now = datetime.now(UTC).isoformat()
    df = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
    if order not in df.columns:
        df = df.withColumn(order, F.monotonically_increasing_id())
    cols = df.columns
    numeric = [c for c in schema.numeric if c in cols]
    raw = df
    df = df.withColumns({f"_raw_{c}": F.col(c) for c in numeric} | {c: clean_text(c) for c in schema.text if c in cols} | {c: number(raw, c) for c in numeric})
    fails = [F.count_if(F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull()).alias(f"fails_{c}") for c in numeric]
    had = [F.min_by("_collected_at_utc", F.when(F.col("_collected_at_utc").isNotNull(), F.col(order))).alias("collected")] if "_collected_at_utc" in cols else []
    clip_them = [c for c in schema.nonnegative if c in numeric]
    bounds, first, _ = winsor_bounds(df, clip_them, more=[*fails, *had])
    df = _clipped(df, clip_them, bounds).drop(*(f"_raw_{c}" for c in numeric))
    bounds = {c: (round(a, 6), round(b, 6)) for c, (a, b) in bounds.items()}
    lat, lon, id_, date = (first_existing(cols, a) for a in (schema.latitude, schema.longitude, schema.ids, schema.dates))
    report: dict = {"dataset": name, "coordinate_columns": {"latitude": lat, "longitude": lon}, "winsorization": {c: {"lower": a, "upper": b} for c, (a, b) in bounds.items()}}
    if lat and lon:
        y, x = (F.col(c) if c in numeric else number(raw, c) for c in (lat, lon))
        swap = swapped(y, x)
        df = df.withColumn("_swap", swap).withColumns({"_latitude": F.when(swap, x).otherwise(y), "_longitude": F.when(swap, y).otherwise(x)})
        df = df.withColumn("_coordinate_valid", in_city(F.col("_latitude"), F.col("_longitude")))
    else:
        df = df.withColumns({"_swap": F.lit(False), "_latitude": F.lit(None).cast("double"), "_longitude": F.lit(None).cast("double"), "_coordinate_valid": F.lit(False)})
    df = df.withColumn("_observation_date", parse_date(F.col(date)) if date else F.lit(None).cast("timestamp"))
    df = df.withColumn("_source_record_id", clean_text(id_) if id_ else F.lit(None).cast("string"))
    missing = F.col("_latitude").isNull() | F.col("_longitude").isNull()
    counts = df.agg(F.count("*").alias("rows"), F.count_if("_swap").alias("swaps"), F.count_if(missing).alias("missing"), F.count_if(~missing & ~F.col("_coordinate_valid")).alias("outside"), F.count_if("_coordinate_valid").alias("valid"))
    if drop_invalid and lat and lon:
        df = df.where("_coordinate_valid")
    keys = [c for c in schema.dedupe if c in cols] or ([id_] if id_ else [])
    if not keys and lat and lon:
        df = df.withColumn("_coordinate_key", F.concat_ws(":", F.coalesce(F.bround("_latitude", 6).cast("string"), F.lit("nan")), F.coalesce(F.bround("_longitude", 6).cast("string"), F.lit("nan"))))
        keys = ["_coordinate_key"]
    if keys:
        df = keep_last(df, keys, order)
    collected = F.lit((collected_at or datetime.now(UTC)).isoformat())
    if "_collected_at_utc" in cols:
        was = first["collected"]
        collected = F.lit(str(was)) if was is not None else collected
    score = F.bround(F.col("_coordinate_valid").cast("double") * 0.60 + F.col("_source_record_id").isNotNull().cast("double") * 0.20 + F.col("_observation_date").isNotNull().cast("double") * 0.20, 3)
    df = df.withColumns({"_source_dataset": F.lit(name), "_collected_at_utc": collected, "_processed_at_utc": F.lit(now), "_preprocessing_version": F.lit("2.0"), "_row_quality_score": score}).drop("_swap")
    r = counts.first()
    n_before = r["valid"] if drop_invalid and lat and lon else r["rows"]
    n_after = df.count() if keys else n_before
    report |= {
        "input_rows": r["rows"], "output_rows": n_after, "removed_rows": r["rows"] - n_after, "duplicate_rows_removed": n_before - n_after, "coordinate_swaps_corrected": r["swaps"] if lat and lon else 0,
        "missing_coordinate_rows": r["missing"] if lat and lon else 0, "out_of_city_rows": r["outside"] if lat and lon else 0, "numeric_parse_failures": {c: first[f"fails_{c}"] for c in numeric}, "missing_required_columns": [c for c in schema.required if c not in cols],
    }
    return df, report


def analysis_columns(columns: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(normalised, counts, all numeric) columns by their names, each once."""
    norm = [c for c in columns if c.endswith("_norm") or c.startswith(("has_", "is_"))]
    counts = [c for c in columns if c.endswith("_count")]
    return norm, counts, list(dict.fromkeys(norm + counts + [c for c in ("length_m", "accident_count") if c in columns]))


def prepare_for_analysis(df: DataFrame) -> tuple[DataFrame, dict]:
    """Medians for missing values, winsorised counts, normalised columns within 0 and 1, flags above q3 + 3 IQR; ``df`` is stored for the passes that this takes."""
    df, _ = stored(df)
    norm, counts, numeric = analysis_columns(df.columns)
    raw, rows = df, df.count()
    df = df.withColumns({f"_raw_{c}": F.col(c) for c in numeric} | {c: number(raw, c) for c in numeric})
    aggs = [F.count_if(F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull()).alias(f"f_{c}") for c in numeric] + [F.count_if(F.col(c).isNull()).alias(f"k_{c}") for c in numeric]
    aggs += [f(c).alias(f"{n}_{c}") for c in dict.fromkeys(norm + counts) for n, f in (("lo", F.min), ("hi", F.max))]
    # Whether three values differ at least: few are kept for each column.
    aggs += [F.count_distinct(c).alias(f"d_{c}") for c in counts] if rows <= AT_ONCE else [F.approx_count_distinct(c, 0.2).alias(f"d_{c}") for c in counts]
    halves = {c: (F.col(c), [0.5]) for c in numeric}
    if rows <= AT_ONCE:
        aggs += [F.median(c).alias(f"m_{c}") for c in numeric]
    r = df.agg(*aggs).first().asDict() if aggs else {}
    med = {c: r[f"m_{c}"] for c in numeric} if rows <= AT_ONCE else {c: q and q[0] for c, q in quantiles(df, halves, rows).items()}
    fails = {"_rows": rows} | {c: r[f"f_{c}"] for c in numeric}
    fill = {c: med[c] if med[c] is not None else 0.0 for c in numeric if r[f"k_{c}"]}
    df = df.drop(*(f"_raw_{c}" for c in numeric)).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
    spread = {f"r_{c}": {n: fill.get(c) if r[f"{n}_{c}"] is None else r[f"{n}_{c}"] for n in ("lo", "hi")} for c in dict.fromkeys(norm + counts)}
    # A median between two values is a third one.
    several = lambda c: r[f"d_{c}"] >= 3 or (r[f"d_{c}"] == 2 and c in fill and spread[f"r_{c}"]["lo"] < fill[c] < spread[f"r_{c}"]["hi"])
    clip_them = [c for c in counts if several(c)]
    bounds, _, q = winsor_bounds(df, clip_them, quarters=counts)
    df = _clipped(df, clip_them, bounds).withColumns({c: clip(F.col(c)) for c in norm})
    bounds = {c: (round(a, 6), round(b, 6)) for c, (a, b) in bounds.items()}
    out: dict = {}
    if counts:
        # Clipping to the outer quantiles leaves the quartiles where they are.
        fences = {c: q[c][1] + 3.0 * (q[c][1] - q[c][0]) for c in counts if q[c] and q[c][1] - q[c][0] > 0}
        n = df.agg(*[F.count_if(F.col(c) > v).alias(c) for c, v in fences.items()]).first().asDict() if fences else {}
        out = {c: k for c, k in n.items() if k}
        df = df.withColumns({f"_outlier_{c}": (F.col(c) > fences[c]).cast("int") for c in out})
    return df, {
        "input_rows": fails.pop("_rows"), "coercion_failures": {c: k for c, k in fails.items() if k}, "median_imputation": {c: round(v, 6) for c, v in fill.items()},
        "winsorization": {c: {"lower": a, "upper": b} for c, (a, b) in bounds.items()},
        "range_clipped_columns": [c for c in norm if spread[f"r_{c}"]["lo"] is not None and (spread[f"r_{c}"]["lo"] < -0.001 or spread[f"r_{c}"]["hi"] > 1.001)], "iqr_outlier_flags": out,
    }


def coordinate_quality(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: total, missing, duplicate, out_of_bbox and pass_rate."""
    df = df.select(number(df, lat).alias("_y"), number(df, lon).alias("_x"))
    y, x = F.col("_y"), F.col("_x")
    missing = y.isNull() | x.isNull()
    key = F.when(~missing, F.struct(F.bround(y, 6), F.bround(x, 6)))
    bad = df.agg(
        F.count("*").alias("total"), F.count_if(missing).alias("missing"), (F.count(key) - F.count_distinct(key)).alias("duplicate"), F.count_if(~missing & ~in_city(y, x)).alias("out_of_bbox"), F.count_if(in_city(y, x)).alias("_ok")
    )
    return bad.withColumn("pass_rate", F.coalesce(F.bround(F.try_divide("_ok", "total"), 4), F.lit(0.0))).drop("_ok")


def suspects(df: DataFrame, lat: str, lon: str, order: str, k: int = 20) -> DataFrame:
    """The first ``k`` rows outside the city."""
    y, x = number(df, lat), number(df, lon)
    return df.where(y.isNotNull() & x.isNotNull() & ~in_city(y, x)).orderBy(order).limit(k)


def quality_of_all(named: dict[str, tuple[DataFrame, str, str]], least: float = 0.95) -> DataFrame:
    """A row of :func:`coordinate_quality` for each dataset, and whether it passes."""
    out = None
    for name, (df, lat, lon) in named.items():
        one = coordinate_quality(df, lat, lon).withColumn("dataset", F.lit(name)).withColumn("passes", F.col("pass_rate") >= least)
        out = one if out is None else out.unionByName(one)
    return out


def drifted(before: int, after: int, most: float = 0.10) -> bool:
    """Whether a count changed by more than a share; any change from nothing is drift."""
    return after > 0 if before == 0 else abs(after - before) / before > most


def minmax(df: DataFrame, column: str, out: str, log_scale: bool = False) -> DataFrame:
    """``column`` scaled to 0..1; constant columns are 0. The bounds are one row, joined by broadcast."""
    from pathwarden.functions.semantics import log_value, minmax_of

    x = log_value(number(df, column), log_scale)
    r = df.agg(F.min(x), F.max(x)).first()
    if r[0] is None:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, minmax_of(x, F.lit(r[0]), F.lit(r[1])))


__all__ = ["SCHEMAS", "PointSchema", "clean_points", "coordinate_quality", "drifted", "in_city", "is_close", "keep_first", "keep_last", "minmax", "prepare_for_analysis", "quality_of_all", "suspects", "swapped", "winsorize"]
