from pathwarden.operators import quality as Q


def test_swap_duplicates_and_far_points(spark):
    rows = [("A", 127.38, 36.35, "  학교  앞 ", 1), ("A", 36.35, 127.38, "학교 앞", 2), ("B", 37.56, 126.97, "서울", 3)]
    df = spark.createDataFrame(rows, "sn string, latitude double, longitude double, name string, _row_ord long")
    out, report = Q.clean_points(df, "school_zone")
    r = out.collect()
    assert len(r) == 1 and r[0]["_latitude"] == 36.35 and r[0]["_longitude"] == 127.38 and r[0]["name"] == "학교 앞"
    assert (report["coordinate_swaps_corrected"], report["duplicate_rows_removed"], report["out_of_city_rows"]) == (1, 1, 1)


def test_raw_columns_pass_through(spark):
    df = spark.createDataFrame([(36.35, 127.38, "x")], "LATITUDE double, LONGITUDE double, custom string")
    out, _ = Q.clean_points(df, "speed_bump")
    r = out.first()
    assert r["custom"] == "x" and r["_source_dataset"] == "speed_bump" and r["_preprocessing_version"] == "2.0"


def test_no_coordinates_and_empty(spark):
    out, report = Q.clean_points(spark.createDataFrame([("a",)], "name string"), "school_zone")
    assert report["coordinate_columns"] == {"latitude": None, "longitude": None} and not out.first()["_coordinate_valid"]
    empty, report = Q.clean_points(spark.createDataFrame([], "sn string, latitude string, longitude string"), "school_zone")
    assert empty.count() == 0 and report["input_rows"] == 0


def test_prepare_clips_imputes_and_flags(spark):
    df = spark.createDataFrame([("a", 1.5, 1, 10.0)], "segment_id string, traffic_volume_norm double, has_crosswalk int, length_m double")
    out, report = Q.prepare_for_analysis(df)
    assert out.first()["traffic_volume_norm"] == 1.0 and report["range_clipped_columns"] == ["traffic_volume_norm"]
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "segment_id string, traffic_volume_norm double")
    out, report = Q.prepare_for_analysis(df)
    assert out.where("traffic_volume_norm is null").count() == 0 and report["median_imputation"] == {"traffic_volume_norm": 0.5}
    df = spark.createDataFrame([(str(i), float(i)) for i in range(100)] + [("x", 10000.0)], "segment_id string, crosswalk_count double")
    out, _ = Q.prepare_for_analysis(df)
    assert "_outlier_crosswalk_count" in out.columns


def test_coordinate_quality(spark):
    df = spark.createDataFrame([(36.35, 127.38), (36.35, 127.38), (None, 127.0), (37.5, 127.0)], "lat double, lon double")
    r = Q.coordinate_quality(df, "lat", "lon").first()
    assert (r["total"], r["missing"], r["duplicate"], r["out_of_bbox"], r["pass_rate"]) == (4, 1, 1, 1, 0.5)
    none = Q.coordinate_quality(spark.createDataFrame([(None, None)], "lat double, lon double"), "lat", "lon").first()
    assert none["missing"] == 1 and none["pass_rate"] == 0.0


def test_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(36.18, 127.29), (36.55, 127.62), (36.179, 127.29)], "lat double, lon double")
    assert [r[0] for r in df.select(Q.in_city(df.lat, df.lon)).collect()] == [True, True, False]
    assert Q.drifted(100, 111) and not Q.drifted(100, 110) and Q.drifted(0, 1)
