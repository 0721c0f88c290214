"""``python -m pathwarden COMMAND``: the batch steps on files."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pathwarden")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("demo", help="the three routes of a small grid")
    for name, what in (("clean", "clean points of a CSV"), ("quality", "check coordinates of a CSV")):
        c = sub.add_parser(name, help=what)
        c.add_argument("input")
        c.add_argument("--dataset", default="points")
        c.add_argument("--output")
        c.add_argument("--lat", default="latitude")
        c.add_argument("--lon", default="longitude")
    for name, what in (("score", "score segments"), ("derive-weights", "weights from evidence"), ("train-edge-model", "models out of fold"), ("risk-zones", "risk classes")):
        c = sub.add_parser(name, help=what)
        c.add_argument("input", help="segments as Parquet")
        c.add_argument("output")
        c.add_argument("--weights", help="JSON of weights")
        c.add_argument("--permutations", type=int, default=499)
    c = sub.add_parser("routes", help="compare routes of pairs")
    for x in ("edges", "pairs", "output"):
        c.add_argument(x)
    c.add_argument("--max-detour", type=float)
    c.add_argument("--ants", action="store_true")
    c = sub.add_parser("evaluate-algorithms", help="search histories and how they were certified")
    for x in ("edges", "pairs", "output"):
        c.add_argument(x)
    c = sub.add_parser("train-region-model", help="ensemble, nested validation and blended segments")
    c.add_argument("input", help="scored segments as Parquet")
    c.add_argument("output")
    c = sub.add_parser("final-evaluation", help="performance, safety gates, districts and manifest")
    c.add_argument("input", help="output of train-region-model")
    c.add_argument("output")
    c.add_argument("--leaderboard", help="leaderboard of train-edge-model")
    c.add_argument("--routes", help="output of routes")
    c.add_argument("--max-detour", type=float, default=1.6)
    c.add_argument("--certification", help="certification of evaluate-algorithms")
    c = sub.add_parser("reclean", help="clean stored datasets again, in place")
    c.add_argument("input", help="folder with dataset=NAME parts")
    c.add_argument("--reports")
    c = sub.add_parser("clean-artifacts", help="delete outputs by pattern")
    c.add_argument("folder")
    c.add_argument("patterns", nargs="+")
    c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)

    from pathwarden.operators import evaluation, evidence, graph, models, quality, regions, routes, scoring
    from pathwarden.session import session
    from pathwarden.sources import files
    from pathwarden.sources.remote import demo_graph

    spark = session(a.master)
    if a.command in (None, "demo"):
        _, edges = demo_graph(spark)
        pair = spark.createDataFrame([("N2_0", "N2_4")], "origin string, destination string")
        for r in routes.compare(graph.edge_costs(edges), pair).orderBy("mode").collect():
            print(f"{r['mode']}: {r['distance']} m, exposure {r['exposure']}, {' '.join(r['path'])}")
    elif a.command == "clean":
        df, report = quality.clean_points(files.read_csv(spark, a.input), a.dataset)
        if a.output:
            df.drop("_row_ord").write.mode("overwrite").parquet(a.output)
        print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
    elif a.command == "quality":
        r = quality.coordinate_quality(files.read_csv(spark, a.input), a.lat, a.lon).first()
        print(json.dumps(r.asDict()))
    elif a.command == "routes":
        out = routes.compare(graph.edge_costs(spark.read.parquet(a.edges)), spark.read.parquet(a.pairs), a.max_detour, ants=a.ants)
        out.write.mode("overwrite").parquet(a.output)
    elif a.command == "evaluate-algorithms":
        edges = graph.edge_costs(spark.read.parquet(a.edges))
        history = routes.search_history(edges, routes.requests(spark.read.parquet(a.pairs), [("shortest", None), ("safest", None), ("balanced", 0.5)]))
        history.write.mode("overwrite").parquet(f"{a.output}/history")
        routes.certification(spark.read.parquet(f"{a.output}/history")).write.mode("overwrite").parquet(f"{a.output}/certification")
    elif a.command == "final-evaluation":
        read = lambda path: spark.read.parquet(path) if path else None
        compared, batch = read(a.routes), None
        if compared is not None:
            batch = routes.od_report(compared, compared.select("origin", "destination").distinct().count(), a.max_detour)
        seeds = spark.createDataFrame([(s["seed"], s["f1_at_shared"]) for s in files.read_report(spark, f"{a.input}/report")["seeds"]], "seed int, f1_at_shared double")
        report = evaluation.evaluate(spark, spark.read.parquet(f"{a.input}/regions"), a.output, datetime.now(UTC).isoformat(), read(a.leaderboard), batch, seeds, certified=read(a.certification))
        print(json.dumps(report["safety_gate_counts"]))
    elif a.command == "reclean":
        print(json.dumps(files.reclean(spark, a.input, a.reports), ensure_ascii=False, indent=2, default=str))
    elif a.command == "clean-artifacts":
        print("\n".join(files.clean_artifacts(spark, a.folder, a.patterns, a.dry_run)))
    elif a.command == "train-region-model":
        segments = spark.read.parquet(a.input)
        segments = segments.withColumn("cmcs_final", F.col("cmcs_final" if "cmcs_final" in segments.columns else "cmcs"))
        table = regions.region_features(segments)
        r = models.region_protocol(regions.with_region(segments), table, [f for f in regions.MODEL_FEATURES if f in table.columns])
        r.regions.write.mode("overwrite").parquet(f"{a.output}/regions")
        r.segments.write.mode("overwrite").parquet(f"{a.output}/segments")
        files.write_report(spark, {"metrics": r.metrics, "nested": r.nested, "blend": r.blend, "seeds": [x.asDict() for x in r.seeds.collect()]}, f"{a.output}/report")
    else:
        segments = spark.read.parquet(a.input)
        weights = scoring.Weights()
        if a.weights:
            weights = scoring.Weights.from_json("\n".join(r["value"] for r in spark.read.text(a.weights).collect()))
        if a.command == "score":
            scoring.score(segments, weights, True).write.mode("overwrite").parquet(a.output)
        elif a.command == "risk-zones":
            df, _ = scoring.risk_score(scoring.score(segments, weights))
            scoring.risk_classes(df).write.mode("overwrite").parquet(a.output)
        elif a.command == "derive-weights":
            cells = regions.evidence_table(segments, evidence.FEATURES).withColumn("cell", F.concat_ws("/", "district", "region_x", "region_y"))
            w, _ = evidence.derive_weights(cells, permutations=a.permutations)
            spark.createDataFrame([(json.dumps(json.loads(w.to_json()), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(a.output)
        else:
            features = [c for c in regions.MEANS if c in segments.columns]
            board, scored, model = models.train_edge_model(scoring.score(segments, weights), features)
            board.write.mode("overwrite").parquet(f"{a.output}/leaderboard")
            scored.write.mode("overwrite").parquet(f"{a.output}/scored")
            if isinstance(model, models.PipelineModel):
                model.write().overwrite().save(f"{a.output}/model")
            else:
                files.write_report(spark, model.to_dict(features), f"{a.output}/model")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
