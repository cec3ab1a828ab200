"""Every core query against its SQL on the smallest tables, and all others for at least a stable schema."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import by_sql, canonical

MODULES = [importlib.import_module(f"strophe.plans.{m}") for m in entry.CORE]
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), by_sql(SQL[name], data)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


#: Queries without SQL, and the tests that compare them with brute force or with data whose answer is known.
ELSEWHERE = {
    "test_brute": {"fuzzy_titles", "note_f1", "melodic_alignment", "missed_segments", "profile_tree", "matched_classes", "clade_support", "label_permutation", "group_folds",
                   "title_clusters", "strategy_accuracy", "transfer_accuracy", "cluster_sweeps", "learning_curve", "domain_weights", "dual_view"},
    "test_learning": {"cross_validated", "stacked", "two_stage", "random_features", "nested_selection", "linear_probe", "top_coefficients", "clusters"},
    "test_custom": {"title_variants"}, "test_operators": {"chi_square_p"},
}


def test_every_query_is_compared_with_something():
    assert set(QUERIES) - set(SQL) == set().union(*ELSEWHERE.values())


@pytest.mark.parametrize("name", sorted(ELSEWHERE["test_learning"] | ELSEWHERE["test_operators"]))
def test_runs_whole(spark, data, name):
    """Over the whole smallest tables: rows of one schema, none of them empty; the answers are checked in the tests named above."""
    got = QUERIES[name](spark, data)
    rows = got.collect()
    assert rows and got.columns and all(v is not None for r in rows for v in r)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_no_nested_loops(spark, data):
    """No query of a join module plans a nested loop over two tables."""
    for name in ("interval_overlap", "nearest_event", "priority_match", "gazetteer_contained", "frames_in_notes", "p6_found"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
