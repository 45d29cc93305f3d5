"""Constraints on writes, cascades, and the greedy choice over whole tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from oreline.operators import constraints, greedy
from oreline.operators.tables import Tables, seeds

from .test_engine import DAY, items

DATE = datetime.date.fromisoformat(DAY)


@pytest.fixture
def strict(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), strict=True)
    t.put_items(items(spark, [("hn", str(i), "u", f"t{i}", "x", i) for i in range(3)] + [(None, "9", "u", "no source", "x", 9)]))
    return t


def reasons(t, name):
    return sorted(r.constraint_name for r in t.rejects().where(F.col("table_name") == name).collect())


def test_each_kind_of_constraint(spark, strict):
    assert strict.read("raw_items").count() == 3 and reasons(strict, "raw_items") == ["source_required"]
    ids = [r.id for r in strict.read("raw_items").orderBy("source_id").collect()]
    ddl = "raw_item_id string, label string, confidence double, audience_fit double"
    strict.put_labels(spark.createDataFrame([(ids[0], "PAIN", 0.5, None), (ids[1], "ANGER", 0.5, 0.5), (ids[2], "NEWS", 1.5, None), ("nobody", "NEWS", 0.5, None), (None, "NEWS", 0.5, None)], ddl))
    assert [r.raw_item_id for r in strict.read("item_labels").collect()] == [ids[0]]
    assert reasons(strict, "item_labels") == ["confidence_range", "label_known", "raw_item_id_required", "raw_item_id_unknown"]
    bad = strict.rejects().where("constraint_name = 'label_known'").first().row
    assert '"label":"ANGER"' in bad and ids[1] in bad
    clusters = spark.createDataFrame([("a", DATE, 0, "A"), ("b", DATE, 0, "B"), ("c", DATE, 1, "C"), ("d", DATE, None, "D")], "id string, date date, cluster_index int, title string")
    members = spark.createDataFrame([(DATE, "a", ids[0]), (DATE, "a", ids[0]), (DATE, "c", "nobody"), (DATE, "zz", ids[1]), (DATE, "c", ids[2])], "date date, cluster_id string, raw_item_id string")
    strict.put_clusters(clusters, members)
    # of two with one key the first as JSON stays; a rejected cluster has no members
    assert sorted(r.id for r in strict.clusters_of(DAY).collect()) == ["a", "c"] and reasons(strict, "clusters") == ["cluster_index_required", "date_cluster_index_unique"]
    assert sorted((r.cluster_id, r.raw_item_id) for r in strict.read("cluster_items").collect()) == sorted([("a", ids[0]), ("c", ids[2])])
    assert reasons(strict, "cluster_items") == ["cluster_id_unknown", "raw_item_id_unknown"]
    interests, sources = seeds(spark)
    strict.seed(interests, sources.unionByName(spark.createDataFrame([("General", "mail", "x", 1.0), ("General", "rss", "y", 3.0)], sources.schema)))
    assert strict.read("interest_sources").count() == 26 and reasons(strict, "interest_sources") == ["source_type_known", "weight_range"]


def test_an_item_takes_its_children_along(spark, strict):
    ids = [r.id for r in strict.read("raw_items").orderBy("source_id").collect()]
    strict.put_labels(spark.createDataFrame([(i, "PAIN") for i in ids], "raw_item_id string, label string"), DAY)
    strict.put_embeddings(spark.createDataFrame([(i, [1.0], "m") for i in ids], "raw_item_id string, embedding array<double>, model string"), DAY)
    two = datetime.date(2024, 2, 4)
    strict.put_clusters(spark.createDataFrame([("a", DATE, 0), ("b", two, 0)], "id string, date date, cluster_index int"), spark.createDataFrame([(DATE, "a", ids[0]), (DATE, "a", ids[1]), (two, "b", ids[0])], "date date, cluster_id string, raw_item_id string"))
    assert {n for n, _ in constraints.CHILDREN["raw_items"]} == {"item_labels", "embeddings", "cluster_items"}
    strict.delete_items(spark.createDataFrame([(ids[0],), ("nobody",)], "id string"))
    assert [sorted(r[0] for r in strict.read(n).select(c).collect()) for n, c in (("raw_items", "id"), ("item_labels", "raw_item_id"), ("embeddings", "raw_item_id"))] == [sorted(ids[1:])] * 3
    assert [(r.cluster_id, r.raw_item_id) for r in strict.read("cluster_items").collect()] == [("a", ids[1])]
    # an id can come back, and is then known again
    strict.put_items(items(spark, [("hn", "0", "u", "back", "x", 1)]))
    strict.put_labels(spark.createDataFrame([(ids[0], "NEWS")], "raw_item_id string, label string"), DAY)
    assert strict.read("raw_items").count() == 3 and strict.read("item_labels").where("label = 'NEWS'").count() == 1


def fold(rows):
    seen, out = set(), []
    for o, keys, always in sorted(rows, key=lambda r: r[0]):
        keys = {k for k in keys or [] if k is not None}
        if always or not keys & seen:
            out.append(o)
            seen |= keys
    return out


@pytest.mark.parametrize("tail", [0, 2_000])
def test_greedy_rounds_equal_the_fold(spark, tail):
    r = random.Random(tail)
    rows = [(o, [f"k{int(r.paretovariate(0.4)) % 9000}" for _ in range(r.randint(0, 4))], r.random() < 0.01) for o in range(10_000)] + [(10_001, None, False), (10_002, [None, "k1"], False)]
    df = spark.createDataFrame(rows, "o long, keys array<string>, always boolean")
    assert sorted(x.o for x in greedy.keep_disjoint(df, "o", "keys", "always", tail).collect()) == fold(rows)


def test_greedy_small_tables(spark):
    chain = [(o, [f"{o}", f"{o + 1}"], False) for o in range(60)]
    for rows in ([], chain, [(1, ["a"], True), (0, ["a"], False), (2, ["a"], False), (3, ["b", "b"], None)]):
        df = spark.createDataFrame(rows, "o long, keys array<string>, always boolean")
        assert sorted(x.o for x in greedy.keep_disjoint(df, "o", "keys", "always").collect()) == fold(rows)
