"""Every query with SQL gives DuckDB's rows on the small tables; the others give rows of a fixed schema."""

import pytest

from pathwarden.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["pareto_front", "avoided_edges", "od_batch", "hybrid_route", "bootstrap_ci", "moran_permutation", "spearman_evidence", "poisson_evidence", "logistic_evidence", "derived_weights"])
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
