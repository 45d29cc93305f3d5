"""Each stage of the pipeline on its own input, against brute force where it has one."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import expected_links, expected_removal, nameless, words  # noqa: F401
from tests.oracle import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        path = str(base / name)
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, stages):
    raw, clean, unique, cut, mixed, encoded = [x.toPandas() for x in stages]
    assert all(list(x.columns) == list(raw.columns) for x in (clean, unique, cut, mixed))
    want = expected_links(zip(clean["doc_id"], clean["text"], strict=True))
    assert set(unique["doc_id"]) == {c for c, _ in want.values()}
    left = {i: (n, gone) for i, n, gone, _ in expected_removal(zip(unique["doc_id"], unique["text"], strict=True))}
    assert {i: len(t.encode().split()) for i, t in zip(cut["doc_id"], cut["text"], strict=True)} == {i: n - gone for i, (n, gone) in left.items()}
    assert set(mixed["doc_id"]) < set(cut["doc_id"]) and len(mixed) > 0.4 * len(cut)
    assert sorted(encoded["doc_id"]) == sorted(mixed["doc_id"]) and (encoded["n_tokens"] == encoded["ids"].str.len()).all()


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    left = set(stages[1].toPandas()["doc_id"])
    toxic, fine = labels[labels["toxic"] == 1]["doc_id"], labels[labels["toxic"] == 0]["doc_id"]
    assert sum(i in left for i in toxic) <= 0.4 * len(toxic) and sum(i in left for i in fine) >= 0.97 * len(fine)


def test_null_ids_stay(spark, nameless):  # noqa: F811
    got = corpus_pipeline.drop_near_duplicates(spark, nameless, SF).toPandas()
    assert list(got.columns) == nameless.columns and len(got) == 6
    texts = list(got["text"])
    assert {words(40, "z"), words(40, "c"), words(30, "u"), words(20, "v")} < set(texts) and texts.count(None) == 1
    assert sum(t in (words(40, "n"), words(40, "n") + " end") for t in texts) == 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]], ids=[n for n, _ in corpus_pipeline.STAGES[1:]])
def test_clashing_columns_stay(spark, nameless, stage):  # noqa: F811
    """Columns named like internal ones, null ids and texts, repeated rows; and no rows at all."""
    extra = {c: F.lit(1) for c in ("_kept", "_hi", "hi", "lo", "row", "p", "kept_text", "draw", "topic", "_id", "starts", "mix_tokens")}
    docs = nameless.withColumns(extra | {"source": F.lit("src0"), "lang": F.lit("en")})
    got = stage(spark, docs, SF)
    if stage is corpus_pipeline.encode:
        assert got.count() == docs.count()
    else:
        assert got.columns == docs.columns and 0 < got.count() <= docs.count()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark, stages):
    got, want = corpus_pipeline.run(spark, SF).toPandas(), stages[-1].toPandas()
    assert sorted(zip(got["doc_id"], got["n_tokens"], strict=True)) == sorted(zip(want["doc_id"], want["n_tokens"], strict=True))


def test_pieces_are_aligned_with_their_texts(spark):
    """The last stage carries pieces to bytes of the text and back to the text, as the operator does."""
    docs = spark.createDataFrame([(1, "Zwei  Wörter\nund mehr"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    data = "Zwei  Wörter\nund mehr".encode()
    assert b"".join(data[a:b] for a, b in zip(got[1].starts, got[1].ends, strict=True)) == data and len(got[1].ids) == len(got[1].starts) + 1
    assert got[1].decoded_sha256 == hashlib.sha256(data).hexdigest() and got[2].starts == got[3].starts == [] and all(r.spans_tile for r in got.values())
