import pytest

import plumbline.plans.fact_queries
import plumbline.plans.family_queries
import plumbline.plans.navigation_queries
import plumbline.plans.search_queries
import plumbline.plans.session_queries
import plumbline.plans.workspace_queries
import plumbline.streaming.queries  # noqa: F401

from plumbline.plans.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_entry_reads_the_smallest_tables(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
