"""Every registered query against its SQL equivalent, or at least to completion."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, rows_of, rows_of_sql

SF_DIR = "/root/testdata/sf0.001"
# The text queries have tests of their own beside them.
QUERIES = {n: f for n, f in entry_point.queries().items() if n not in entry_point.TEXT_QUERIES}
SQL = {n: s for n, s in entry_point.oracle_sql().items() if n not in entry_point.TEXT_SQL}
# Rows only: nothing in SQL says what an adaptive window or grown trees give.
ROWS_ONLY = {
    "adwin", "adwin_binned", "drift_chain", "row_trace", "drift_metrics_runs", "cloud_model", "retrain_candidate",
    "stream_detect", "edge_tree", "edge_tree_scores",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_only_the_sequential_and_learned_ones_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    cols, rows = rows_of(QUERIES[name](spark, SF_DIR))
    if name in SQL:
        want_cols, want = rows_of_sql(duck, SQL[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    assert entry_point.entry(spark).count() == 15  # fifteen users at this scale
