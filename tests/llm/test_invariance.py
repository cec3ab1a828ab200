import pytest

from strophe.llm.registry import query_modules
from tests.compare import canonical
from tests.test_invariance import copy, empty, shuffled  # noqa: F401

QUERIES = {n: q for m in query_modules() for n, q in m.QUERIES.items()}
NAMES = ["p1_found", "p3_found", "p4_found", "p5_found", "p7_found", "p7_splits", "p9_leaks", "p10_pieces"]


@pytest.mark.parametrize("name", NAMES)
def test_order_does_not_matter(spark, data, shuffled, name):  # noqa: F811
    assert canonical(QUERIES[name](spark, data).toPandas()) == canonical(QUERIES[name](spark, shuffled).toPandas())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"p8_waste", "p3_overlap_report"}))
def test_empty_tables(spark, empty, name):  # noqa: F811
    assert QUERIES[name](spark, empty).count() == 0
