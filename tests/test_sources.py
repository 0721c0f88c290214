import json

import pytest
from pyspark.sql import functions as F

from pathwarden.sources import files as S
from pathwarden.sources import remote as W


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp949"])
def test_csv_encodings(spark, tmp_path, encoding):
    p = tmp_path / "a.csv"
    p.write_bytes("이름,값\n학교,1\n".encode(encoding))
    r = S.read_csv(spark, str(p)).collect()
    assert r[0].asDict() == {"이름": "학교", "값": "1"}


def test_missing_files(spark, tmp_path):
    assert S.try_csv(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(FileNotFoundError):
        S.first_match(spark, str(tmp_path), "*.csv")


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [127.1, 36.2]}, "properties": {"osmid": "1"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [127.1, 36.2]}, "properties": {"osmid": "1"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"name": "p"}},
    ]}
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps(doc))
    f = S.read_geojson(spark, str(p))
    assert S.geojson_points(f).count() == 1 and len(S.geojson_rings(f, "name").first()["ring"]) == 4


def test_graphml(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text('<graphml><key id="d0" for="node" attr.name="x" attr.type="double"/><key id="d1" for="edge" attr.name="length" attr.type="double"/><graph edgedefault="directed"><node id="a"><data key="d0">1.5</data></node><node id="b"/><edge source="a" target="b" id="0"><data key="d1">7</data></edge></graph></graphml>')
    nodes, edges = S.read_graphml(spark, str(p))
    assert {(r["node"], r["x"]) for r in nodes.collect()} == {("a", "1.5"), ("b", None)}
    e = edges.first()
    assert (e["u"], e["v"], e["length"]) == ("a", "b", "7")


def test_reports(spark, tmp_path):
    S.write_report(spark, {"a": 1, "이름": "x"}, str(tmp_path / "r"))
    assert S.read_report(spark, str(tmp_path / "r")) == {"a": 1, "이름": "x"}
    for n in (1, 2):
        S.upsert_report(spark, {"dataset": "d", "n": n}, str(tmp_path / "u"))
    S.upsert_report(spark, {"dataset": "e", "n": 3}, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_paging(spark):
    def fetch(url):
        page = int(url.split("pageNo=")[1].split("&")[0])
        items = [{"id": page * 10 + i} for i in range(2)] if page < 3 else {"id": 30}
        return json.dumps({"response": {"header": {"resultCode": "00"}, "body": {"totalCount": 5, "items": {"item": items}}}})

    df = W.fetch_rows(spark, fetch, "http://x", {}, "id int, search_year int", {"year": [2012, 2013]})
    assert df.count() == 10 and df.select("search_year").distinct().count() == 2
    with pytest.raises(ValueError):
        W.payload(json.dumps({"header": {"resultCode": "99"}}))
    frames, bad = W.fetch_all({"a": lambda: df, "b": lambda: 1 / 0})
    assert list(frames) == ["a"] and list(bad) == ["b"]


def test_geocode_cache(spark):
    cache = spark.createDataFrame([("x", 36.0, 127.0)], "address string, lat double, lon double")
    df = spark.createDataFrame([("x",), ("y",)], "address string")
    out, _ = W.geocode(df, cache)
    assert {(r["address"], r["lat"]) for r in out.collect()} == {("x", 36.0), ("y", None)}
    out, whole = W.geocode(df, cache, lambda a: None)
    assert whole.where(F.col("lat").isNull()).count() == 1


def test_stream(spark, tmp_path):
    from pathwarden.operators.quality import PointSchema
    from pathwarden.streaming.points import clean_stream, read_stream

    schema = "sn string, latitude double, longitude double, _row_ord long"
    spark.createDataFrame([("a", 36.3, 127.4, 1), ("a", 36.3, 127.4, 2)], schema).write.parquet(str(tmp_path / "in"))
    q = clean_stream(read_stream(spark, str(tmp_path / "in"), schema), "p", PointSchema("p", dedupe=("sn",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
