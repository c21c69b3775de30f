"""Every registered query against its SQL on the small data set."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from slidewatch.plans.queries import QUERIES as REGISTERED
from tests.conftest import SMALL

QUERIES = {name: query for name, query in entry.queries().items() if name in REGISTERED}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTERED}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"model_recommendations", "model_metrics", "model_trials"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    problem = compare(QUERIES[name](spark, SMALL), con, ORACLE[name])
    assert problem is None, problem


def test_models_score_every_open_segment(spark, tables):
    recs = QUERIES["model_recommendations"](spark, SMALL).collect()
    assert len(recs) == tables.open_rows.count()
    assert all(r["action_ranking"].count(",") == 2 for r in recs)
    metrics = QUERIES["model_metrics"](spark, SMALL).first()
    assert 0 < metrics["outcomes"] < 6000 and metrics["rmse"] < 0.01
    trials = QUERIES["model_trials"](spark, SMALL).collect()
    assert len(trials) == 12 and trials[0]["rmse"] <= trials[-1]["rmse"]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["risk_rank"] for r in rows] == list(range(1, len(rows) + 1))
