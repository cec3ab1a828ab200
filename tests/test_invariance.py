"""Results do not depend on the order or the partitions of the rows, and empty tables give empty results."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import canonical

NAMES = ["p2_found", "p6_found", "coverage_matrix", "first_distinct_values", "lookup_last_wins", "priority_match", "nearest_event", "interval_overlap", "keyed_dedup_first", "merged_repeats", "contour_tokens", "kruskal_by_region", "bootstrap_accuracy", "quota_sample", "group_folds", "representatives", "near_duplicate_names", "stream_latest", "song_registry"]
QUERIES = {n: q for m in entry.CORE for n, q in importlib.import_module(f"strophe.plans.{m}").QUERIES.items()}


def copy(spark, data, to, change):
    for f in os.listdir(data):
        change(spark.read.parquet(f"{data}/{f}")).write.parquet(f"{to}/{f}")
    return str(to)


@pytest.fixture(scope="session")
def shuffled(spark, data, tmp_path_factory):
    return copy(spark, data, tmp_path_factory.mktemp("shuffled"), lambda t: t.orderBy(F.rand(3)).repartition(5))


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory):
    return copy(spark, data, tmp_path_factory.mktemp("empty"), lambda t: t.where("false").coalesce(1))


@pytest.mark.parametrize("name", NAMES)
def test_order_does_not_matter(spark, data, shuffled, name):
    assert canonical(QUERIES[name](spark, data).toPandas()) == canonical(QUERIES[name](spark, shuffled).toPandas())


#: Queries whose result is one row of totals, whatever the input.
ONE_ROW = {"describe_column", "keyword_presence", "headline_numbers"}


@pytest.mark.parametrize("name", [*NAMES[:8], "describe_column", "keyword_presence", "rolling_median", "tonic_by_template", "review_rows", "connected_groups", "unified_items", "anchors_filled", "false_discovery"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name in ONE_ROW else 0)


MODELS = ["title_clusters", "strategy_accuracy", "dual_view", "transfer_accuracy", "domain_weights", "cluster_sweeps", "learning_curve", "clade_support", "label_permutation", "cross_validated", "clusters", "linear_probe", "profile_tree", "matched_classes", "top_coefficients", "stacked", "nested_selection", "two_stage", "random_features"]


@pytest.mark.parametrize("module", ["music", "files", "learning", "custom", "streams"])
def test_whole_modules_on_empty_tables(spark, empty, module):
    """Nothing in, nothing out; numbers of a paper and a filled template are written of nothing, too."""
    for name, q in importlib.import_module(f"strophe.plans.{module}").QUERIES.items():
        assert q(spark, empty).count() == {"paper_numbers": 3, "filled_template": 1}.get(name, 0), name


@pytest.mark.parametrize("name", MODELS)
def test_nothing_to_fit(spark, data, empty, name):
    got = QUERIES[name](spark, empty)
    assert got.count() == 0 and got.columns


@pytest.mark.parametrize("name", ["token_vocabularies", "feature_vector", "song_features", "audited_notes", "intonation_features", "augmented_notes", "multi_view_terms", "cross_fold_duplicates", "left_out_platforms", "role_excerpts", "few_shots", "annotator_orders", "null_percentile", "note_f1", "clade_support", "custom_aggregate", "stream_sessions"])
def test_order_does_not_matter_to_the_rest(spark, data, shuffled, name):
    assert canonical(QUERIES[name](spark, data).toPandas()) == canonical(QUERIES[name](spark, shuffled).toPandas())
