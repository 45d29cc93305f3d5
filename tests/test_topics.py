"""TF-IDF vectors, k-means over them and orphans, against brute force on small tables."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.linalg import Vectors

from oreline.operators import topics


def test_tfidf_vectors_match_brute_force(spark):
    stop = topics.english_stop_words()
    texts = {1: "The cat and the dog ran; cat dog", 2: "a dog of the sea", 3: None, 4: "sea cat sea cat sea", 5: "the of and", 6: "x unique9 Word"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    terms = {}
    for i, t in texts.items():
        w = [x for x in re.findall(r"\w{2,}", (t or "").lower()) if x not in stop]
        terms[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    total = sum(terms.values(), Counter())
    vocabulary = sorted(total, key=lambda t: (-total[t], t))[:6]
    assert "cat dog" in vocabulary and "the" not in vocabulary
    df = {t: sum(t in c for c in terms.values()) for t in vocabulary}
    got = {r["doc_id"]: r["features"].toArray() for r in topics.tfidf_vectors(docs, "doc_id", "text", 6, stop).collect()}
    for i, c in terms.items():
        w = np.array([c[t] * (math.log(7 / (1 + df[t])) + 1) for t in vocabulary])
        assert np.allclose(got[i], w / (np.linalg.norm(w) or 1))


def test_tfidf_vectors_read_texts_once(spark):
    """Words, pairs and weights come from one reading."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [(i, f"alpha beta w{i} gamma alpha beta") for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).mapInArrow(told, "doc_id long, text string")
    got = topics.tfidf_vectors(docs, "doc_id", "text", 5)
    assert got.count() == 12 and read.value == 12


def test_tfidf_vectors_with_too_many_frequent_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta w{i} gamma alpha beta") for i in range(12)], "doc_id long, text string")
    want = {r["doc_id"]: r["features"] for r in topics.tfidf_vectors(docs, "doc_id", "text", 7).collect()}
    monkeypatch.setattr(topics, "MOST_WORDS", 2)
    assert {r["doc_id"]: r["features"] for r in topics.tfidf_vectors(docs, "doc_id", "text", 7).collect()} == want


def test_single_rows_are_placed(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [0.9, 0.1, 0.0]), (3, 1, [0.0, 1.0, 0.0]), (4, 1, [0.0, 1.0, 0.1]), (5, 2, [0.1, 0.8, 0.0]), (6, 3, [0.7, 0.0, 0.2]), (7, 4, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, cluster int, v array<double>")
    got = {r["id"]: r["cluster"] for r in topics.reassign_orphans(df, "id", "cluster", "v").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_kmeans_is_the_same_for_any_partitions(spark):
    """Three groups far apart, a single row near one of them, an id of text, repeated rows; as many clusters as rows."""
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", (np.eye(3)[i % 3] * 9 + rng.normal(size=3) * 0.1).tolist()) for i in range(30)] + [("r99", [30.0, 0.0, 0.0]), ("r98", [9.0, 0.0, 0.0]), ("r97", [9.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    runs = [{r["id"]: r["cluster"] for r in topics.kmeans(df.repartition(n), "k", "v", k=4).collect()} for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 33
    groups = [{runs[0][f"r{i}"] for i in range(j, 30, 3)} for j in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and runs[0]["r99"] == runs[0]["r0"] == runs[0]["r98"]
    assert sorted(r["cluster"] for r in topics.kmeans(df.limit(2), "k", "v").collect()) in ([0, 1], [0, 0]) and topics.kmeans(df.limit(0), "k", "v").count() == 0


def test_top_terms_with_and_without_a_shuffle(spark, monkeypatch):
    """Pairs are counted only of frequent words, which loses none: ties, groups of few words, repeated words, null and empty texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(int(i), int(i % 4), " ".join(rng.choice(words, size=rng.integers(0, 40), p=np.arange(30, 0, -1) / 465))) for i in range(120)]
    rows += [(200, 5, "one"), (201, 5, None), (202, 6, ""), (203, 7, "the of"), (204, 8, "echo echo echo echo"), (205, 9, "a1 b1 c1 d1"), (206, 9, "c1 d1 a1 b1")]
    docs = spark.createDataFrame(rows, "doc long, g int, text string")
    for features, k in ((5, 3), (12, 5), (200, 5)):
        rank = lambda df: sorted(tuple(r) for r in df.select("g", "term", "rank", "score").collect())
        want = rank(topics.top_terms_by_shuffle(docs, "g", "doc", "text", k, ["the", "of"], features))
        got = rank(topics.top_terms(docs, "g", "doc", "text", k, ["the", "of"], features))
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    monkeypatch.setattr(topics, "MOST_WORDS", 3)
    assert rank(topics.top_terms(docs, "g", "doc", "text", k, ["the", "of"], features)) == want
    assert topics.top_terms(docs.where("g = 6"), "g", "doc", "text").count() == 0


def test_no_exchange_on_documents(spark):
    docs = spark.createDataFrame([(1, 0, "some words of a text"), (2, 0, "other words of it")], "doc long, g int, text string")
    plan = topics.top_terms(docs, "g", "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(g" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "doc" in x]
