"""The final evaluation: how the models do, which gates hold, by district, and what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwarden.operators.metrics import bootstrap, calibration_error, confusion, ranking_metrics, regional_metrics
from pathwarden.storage import cut

# States of a gate, and what they ask for.
GOOD, CONDITIONAL, POOR = "good", "conditional", "poor"
LEAST_AUC, LEAST_LIFT, LEAST_RECALL, LEAST_F1 = 0.70, 2.0, 0.65, 0.5
REVIEW_SKILL, REVIEW_RECALL = 0.10, 0.70
NESTED = {"nested_oof_probability", "nested_oof_prediction", "nested_decision_threshold"}
# The performance that stands in where no split by years was made.
NO_SPLIT = {"roc_auc": 0.0, "brier": 1.0, "dummy_brier": 1.0}


def judged(predictions: DataFrame, label: str = "accident_label", n: str | None = None) -> DataFrame:
    """``predictions`` with y, p, hit and at: the nested held-out ones where they are there, else the plain held-out ones at their best F1 threshold.  Rows count ``n`` times."""
    y = F.col(label).cast("int").alias("y")
    if NESTED <= set(predictions.columns):
        at = F.col("nested_decision_threshold").cast("double")
        return predictions.select("*", y, F.col("nested_oof_probability").cast("double").alias("p"), F.col("nested_oof_prediction").cast("int").alias("hit"), at.alias("at"))
    d = predictions.select("*", y, F.col("oof_risk_probability").cast("double").alias("p"))
    best = ranking_metrics(d, "y", "p", n=n).first()
    at = float(best["f1_threshold"]) if best else 0.5
    return d.withColumns({"hit": (F.col("p") >= at).cast("int"), "at": F.lit(at)})


def alike(predictions: DataFrame) -> DataFrame:
    """Each distinct row of ``predictions`` once, stored, and ``n``, how many there are: all measures are made of these."""
    return cut(predictions.groupBy(*predictions.columns).agg(F.count(F.lit(1)).alias("n")))


def overall(d: DataFrame, n: str | None = None) -> DataFrame:
    """One row of :func:`judged` rows: ranking, rates, calibration and the mean threshold.  Rows count ``n`` times."""
    rank, rates = regional_metrics(d, "y", "p", n=n), confusion(d, "y", F.col("hit") == 1, n=n)
    times = F.lit(1) if n is None else F.col(n)
    base = d.where("y is not null").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, times)), F.lit(0)).alias("positives"), (F.sum(F.col("at") * times) / F.sum(F.when(F.col("at").isNotNull(), times))).alias("threshold"))
    return rank.join(rates, F.lit(True)).join(base, F.lit(True)).join(calibration_error(d, "y", "p", n=n).select("ece"), F.lit(True))


def by_district(d: DataFrame, group: str = "district", n: str | None = None) -> DataFrame:
    """A row for each district: rows, positives, precision, recall, f1, and the ranking where both classes are there."""
    d = d.where("y is not null")
    rank = ranking_metrics(d, "y", "p", [group], n).select(F.col(group).alias("_g"), "roc_auc", "average_precision")
    rates = confusion(d, "y", F.col("hit") == 1, [group], n)
    got = rates.join(rank, rates[group].eqNullSafe(rank["_g"]), "left")
    return got.select(group, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), (F.col("fn") + F.col("tp")).alias("positives"), "precision", "recall", "f1", "roc_auc", "average_precision")


def performance(edge_board: DataFrame | None, region: DataFrame) -> DataFrame:
    """(unit, model, roc_auc, average_precision, f1, brier, state): the edge models' leaderboard above the regional ensemble."""
    cols = [F.col(c).cast("double").alias(c) for c in ("roc_auc", "average_precision")]
    own = region.select(F.lit("region").alias("unit"), F.lit("ensemble").alias("model"), *cols, F.col("f1").cast("double").alias("f1"), F.col("brier").cast("double").alias("brier"), F.lit(CONDITIONAL).alias("state"))
    if edge_board is None:
        return own
    edges = edge_board.select(F.lit("edge").alias("unit"), "model", *cols, F.col("f1_best").cast("double").alias("f1"), F.col("brier").cast("double").alias("brier"), F.lit(POOR).alias("state"))
    return edges.unionByName(own)


def _state(*rules: tuple[Column, str], otherwise: str = POOR) -> Column:
    """The state of the first rule that holds; a measure that is missing holds none."""
    return reduce(lambda rest, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def safety_gates(region: DataFrame, districts: DataFrame, routes: DataFrame | None = None, seeds: DataFrame | None = None, quality: DataFrame | None = None, split: DataFrame | None = None) -> DataFrame:
    """(area, measure, value, state): each measure of each area with the area's state.

    ``region`` is :func:`overall`, ``districts`` :func:`by_district`, ``routes`` :func:`~pathwarden.operators.routes.od_report`, ``seeds``
    has f1_at_shared, ``quality`` pass_rate of each dataset, ``split`` roc_auc, brier and dummy_brier of a split by years.  What isn't given is judged as missing.
    """
    spark = region.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    seeds = none("f1_at_shared double") if seeds is None else seeds
    quality = none("pass_rate double") if quality is None else quality
    split = spark.createDataFrame([tuple(NO_SPLIT.values())], ", ".join(f"{c} double" for c in NO_SPLIT)) if split is None else split
    routes = none("evaluated long, positive_share double, median_reduction double, exceeded long, stable boolean") if routes is None else routes
    one = lambda df, **cols: df.agg(*(c.alias(n) for n, c in cols.items()))
    # One row each, so these joins are of single rows.
    parts = [
        one(districts, least_district_f1=F.min("f1"), most_district_f1=F.max("f1")), one(seeds, least_seed_f1=F.min("f1_at_shared"), seed_deviation=F.stddev_pop("f1_at_shared")),
        one(quality, least_pass_rate=F.min("pass_rate")), one(split, split_auc=F.max("roc_auc"), split_brier=F.max("brier"), dummy_brier=F.max("dummy_brier")),
        one(routes, evaluated=F.max("evaluated"), positive_share=F.max("positive_share"), median_reduction=F.max("median_reduction"), stable=F.bool_and("stable")),
    ]
    row = reduce(lambda a, b: a.join(b, F.lit(True)), parts, region)
    c = F.col
    areas = [
        ("ranking", _state(((c("roc_auc") >= LEAST_AUC) & (c("ap_lift") >= LEAST_LIFT), GOOD)), ["roc_auc", "average_precision", "ap_lift"]),
        ("missed_risk", _state((c("recall") >= LEAST_RECALL, CONDITIONAL)), ["recall", "positives", "fn"]),
        ("seed_stability", _state((c("least_seed_f1") >= LEAST_F1, GOOD)), ["least_seed_f1", "seed_deviation"]),
        ("calibration", _state(((c("brier_skill") >= REVIEW_SKILL) & (c("recall") >= REVIEW_RECALL), CONDITIONAL)), ["brier", "brier_skill", "ece"]),
        ("spatial", F.lit(CONDITIONAL), ["least_district_f1", "most_district_f1"]),
        ("temporal", _state(((c("split_auc") >= LEAST_AUC) & (c("split_brier") < c("dummy_brier")), CONDITIONAL)), ["split_auc", "split_brier", "dummy_brier"]),
        ("completeness", F.lit(POOR), ["least_pass_rate", "positives"]),
        ("routes", _state((c("stable"), GOOD), otherwise=CONDITIONAL), ["evaluated", "positive_share", "median_reduction"]),
        ("deployment", F.lit(POOR), ["brier_skill", "recall"]),
    ]
    cells = [F.struct(F.lit(a).alias("area"), F.lit(m).alias("measure"), c(m).cast("double").alias("value"), s.alias("state")) for a, s, ms in areas for m in ms]
    return row.select(F.explode(F.array(*cells)).alias("g")).select("g.*")


def state_counts(gates: DataFrame) -> DataFrame:
    """(state, areas)"""
    return gates.select("area", "state").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("areas"))


def manifest(files: dict[str, str], routes: DataFrame | None, certified: DataFrame | None, at: str, base: str) -> dict:
    """What was written, told from ``base``, with the key figures of a batch of routes and of their certification."""
    from pathwarden.sources.files import relative_paths

    r = routes.first().asDict() if routes is not None else {}
    n = r.get("evaluated") or 0
    key = {"risk_reduction_pct": r.get("mean_reduction"), "mean_detour_ratio": r.get("mean_detour"), "detour_constraint_satisfaction_rate": (n - r["exceeded"]) / n if n else None}
    if certified is not None:
        c = certified.agg(
            F.try_divide(F.sum(F.col("proven_rate") * F.col("routes")), F.sum("routes")).alias("rcsp_certification_rate"), F.try_divide(F.sum(F.col("feasible_rate") * F.col("routes")), F.sum("routes")).alias("aco_success_rate"),
            F.try_divide(F.sum(F.col("mean_gap_pct") * F.col("routes")), F.sum(F.when(F.col("mean_gap_pct").isNotNull(), F.col("routes")))).alias("mean_gap_pct"),
        )
        key |= c.first().asDict()
    return {"generated_at": at, "files": relative_paths(files, base), "key_metrics": key}


def evaluate(spark: SparkSession, predictions: DataFrame, out: str, at: str, edge_board: DataFrame | None = None, routes: DataFrame | None = None, seeds: DataFrame | None = None, quality: DataFrame | None = None,
             split: DataFrame | None = None, certified: DataFrame | None = None, group: str = "district") -> dict:
    """The whole evaluation written below ``out``: tables of performance, gates, districts and intervals, a report, its text and the manifest; gives the report."""
    from pathwarden.operators.reports import markdown
    from pathwarden.sources.files import write_csv, write_report

    d = cut(judged(predictions))
    region, districts = cut(overall(d)), cut(by_district(d, group))
    intervals = bootstrap(d, "y", "p", float(region.first()["threshold"] or 0.5))
    gates = safety_gates(region, districts, routes, seeds, quality, split)
    tables = {"performance": performance(edge_board, region), "gates": gates, "districts": districts, "intervals": intervals}
    files = {}
    for name, df in tables.items():
        files[name] = f"{out.rstrip('/')}/{name}"
        write_csv(df.coalesce(1), files[name], bom=True)
    gates = cut(gates)
    report = {
        "evaluation_date": at[:10], "regional_metrics": {k: round(v, 6) if isinstance(v, float) else v for k, v in region.first().asDict().items()},
        "bootstrap_95_percent_intervals": {r["metric"]: [r["lower"], r["upper"]] for r in intervals.collect()}, "district_metrics": [r.asDict() for r in districts.orderBy(group).collect()],
        "safety_gate_counts": {r["state"]: r["areas"] for r in state_counts(gates).collect()}, "artifacts": {k: k for k in files},
    }
    files["report"], files["text"] = f"{out.rstrip('/')}/report", f"{out.rstrip('/')}/text"
    write_report(spark, report, files["report"])
    text = "\n\n".join(["# Final evaluation", "## Models", markdown(tables["performance"]), "## Gates", markdown(gates.orderBy("area", "measure")), "## Districts", markdown(districts.orderBy(group))])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(files["text"])
    write_report(spark, manifest(files, routes, certified, at, out), f"{out.rstrip('/')}/manifest")
    return report
