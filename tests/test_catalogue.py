"""Every query of the engine against its SQL on the small tables; those without SQL against invariants."""

import pytest

from oreline.plans.catalogue import QUERIES, SQL

from .oracle import SF, assert_same, tables


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), con, SQL[name])


@pytest.mark.parametrize(("name", "table", "key"), [("kmeans_embeddings", "embeddings", "vec_id"), ("kmeans_tfidf", "documents", "doc_id")])
def test_clusters_partition_the_input(spark, con, name, table, key):
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got["id"]) == [r[0] for r in con.sql(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    assert 2 <= got["cluster"].nunique() <= 15
