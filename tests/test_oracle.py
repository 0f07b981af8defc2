"""A sample of registered queries against their SQL counterparts on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "agg_poll_weighted_mean asof_filter join_asof_latest join_override win_revision_number_latest win_monotonic_check "
    "win_sliding_rate agg_security_events hash_integrity job_feature_snapshot st_event_validate snk_append_idempotent"
).split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    problem, count = compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name])
    assert problem == "" and count > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_every_query_can_be_built(spark):
    """Plans of all registered queries but streams, which run as they are built (tests/test_streams.py)."""
    for name, query in entry.queries().items():
        if not name.startswith(("st_", "op")) and name != "pipeline":
            assert query(spark, FOLDER).columns, name


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
