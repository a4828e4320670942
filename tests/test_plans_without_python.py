"""Queries of the corpus whose executors must start no Python worker."""

import pytest

from wardline.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["prepared_corpus", "conflict_groups", "remaining_conflicts"])
def test_corpus_queries_run_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
