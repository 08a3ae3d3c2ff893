"""Every query of the library against its SQL; those without SQL run and return rows."""

import pytest

from fundweave.plans import catalogue, learn
from tests import oracle

#: Compared below, or with few trees in test_learn.
SLOW = {"replay_stream", "pin_stream_parity", "online_features_parity", "boosted_tree_scores", "edge_ranker"}


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL.keys() - SLOW))
def test_query_equals_its_sql(spark, con, name):
    oracle.compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys() - SLOW))
def test_query_returns_rows(spark, name):
    # Models need accounts of both classes on both sides of the split.
    n = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01" if name in learn.QUERIES else oracle.DATA).count()
    assert n > 0 or name == "funding_clusters"  # too few events there for a cluster


def test_streams_equal_batches(spark, con):
    for name in ("replay_stream", "online_features_parity"):
        oracle.compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert catalogue.QUERIES["pin_stream_parity"](spark, oracle.DATA).first().differing == 0


def test_entry_module(spark):
    import __spark_entry__

    assert catalogue.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0
