"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oreline.llm import html, jaccard, mixing, nearest, pieces, quality, sharding, substring, tokenfiles, toxicity
from oreline.llm.wordhash import hash_words, sliding, window_hashes
from tests.oracle import SF, assert_same, tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_crc32 int, hi string, count int"


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, near copies, a shared passage; columns whose names clash with internal ones."""
    passage = words(60, "p")
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "no id here"), (5, words(40, "a")), (6, words(40, "a") + " end"), (7, words(40, "a")), (8, words(30, "x") + " " + passage), (9, passage + "\n" + words(30, "y")), (10, "word " * 200), (11, words(60_000, "long")), (12, "é😀 ▁x  y\n\nz")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "src0", None, 1, "h", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def expected_links(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for i, s in sets.items():
        for g in s:
            inverted.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in inverted.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_word_hashes():
    texts = [b"a b\x0bc", b"", b"  ", "é ü a".encode(), b"x" * 5_000_000 + b" tail"]
    off, (h,) = hash_words(texts)
    assert np.diff(off).tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[5] and len(set(h.tolist())) == len(h) - 1
    assert (window_hashes(np.tile(h[:2], 3), 2)[::2] == window_hashes(h[:2], 2)).all()
    v = np.random.default_rng(1).integers(0, 99, 50)
    for w in (1, 2, 5, 26, 50, 51):
        assert sliding(v, w).tolist() == [v[i : i + w].min() for i in range(50 - w + 1)]


def test_lanes_are_independent():
    """Two long words on which polynomial hashes modulo 2**64 agree whatever the base."""
    a = "01"
    for _ in range(12):
        a += a.translate({48: 49, 49: 48})
    x, y = a.encode(), a.translate({48: 49, 49: 48}).encode()
    off, lanes = hash_words([x, y, x[:200], y[:200]], 2)
    assert all(len(set(h.tolist())) == 4 for h in lanes) and not set(lanes[0].tolist()) & set(lanes[1].tolist())
    for size in range(1, 40):  # every way a word is cut into blocks
        one = [bytes([65 + i % 20]) * size for i in range(20)] + [b"A" * (size - 1) + b"Z"]
        assert len(set(hash_words(one)[1][0].tolist())) == 21


def test_op1_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = jaccard.op1_jaccard_join(spark, SF).toPandas()
    want = expected_links(zip(docs["doc_id"], docs["text"], strict=True))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == want


def test_op1_splits_large_buckets(spark, monkeypatch):
    """Buckets beyond the size for brute force: a dense one is compared in blocks, a loose one is split."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    base = [f"w{i}" for i in range(80)]
    near = [" ".join([*base[:70], *(f"n{k}x{i}" for i in range(2)), *base[72:]]) for k in range(14)]
    rows = list(enumerate(near + [words(50, f"u{k}_") for k in range(20)]))
    rows, texts = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.first_id: (r.class_id, r.n_links) for r in texts.collect()}
    assert got == expected_links(enumerate(near + [words(50, f"u{k}_") for k in range(20)]))


def test_op1_odd_rows(spark, odd, none):
    rows, texts = jaccard.near_duplicates(odd)
    by = {(r.first_id, r.n_words): (r.class_id, r.n_links, r.copies) for r in texts.collect()}
    assert by[(4, 2)] == (4, 1, 2) and by[(5, 40)] == (5, 2, 2) and by[(6, 41)][:2] == (5, 2)
    assert rows.count() == odd.count() and [v[1] for k, v in by.items() if k[1] == 0] == [0, 0]
    assert jaccard.near_duplicates(none)[1].count() == 0


@pytest.fixture(scope="module")
def nameless(spark):
    """A text under a null id that is near to one with an id and to another without, two near texts without any id, a repeated one alone, and id 0."""
    chain = [words(40, "c") + x for x in ("", " end", " end of it")]
    rows = [(0, words(40, "z")), (5, chain[0]), (None, chain[1]), (9, chain[2]), (None, words(40, "n")), (None, words(40, "n") + " end"), (None, words(30, "u")), (None, words(30, "u")), (None, None), (7, words(20, "v"))]
    return spark.createDataFrame([(i, t, "en", "src0", None, 1, "h", 2) for i, t in rows], DOCS)


def test_op1_null_ids(spark, nameless):
    rows, texts = jaccard.near_duplicates(nameless)
    got = rows.join(texts, ["hi", "lo"]).join(nameless.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hi"), "text").distinct(), "hi").select("text", "class_id", "n_links", "stays").distinct().toPandas()
    by = {t: (None if pd.isna(c) else int(c), n, s) for t, c, n, s in got.itertuples(index=False)}
    want = expected_links([(r.text, r.text) for r in nameless.select("text").where("text is not null").distinct().collect()])
    copies = Counter(r.text for r in nameless.select("text").collect())
    assert all(by[t][1] == n + copies[t] - 1 for t, (_, n) in want.items())
    c, n = words(40, "c"), words(40, "n")
    assert [by[c + x] for x in ("", " end", " end of it")] == [(5, 2, True), (5, 2, False), (5, 2, False)]
    assert [by[x][:2] for x in (n, n + " end")] == [(None, 1)] * 2 and by[n][2] != by[n + " end"][2]
    assert by[words(30, "u")] == (None, 1, True) and by[words(40, "z")] == (0, 0, True)


def expected_removal(docs):
    seen, own = Counter(), []
    for i, t in docs:
        w = (t or "").encode("utf-8", "replace").split()
        own.append((i, w))
        seen.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    for i, w in own:
        gone = set()
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_op5_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = substring.op5_substring(spark, SF).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(expected_removal(zip(docs["doc_id"], docs["text"], strict=True)))


def test_op5_odd_rows_and_compaction(spark, odd, none):
    rows, texts = substring.repeated_substrings(odd.where("doc_id <> 11 or doc_id is null"), batches=3)
    got = sorted((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows.join(texts, ["hi", "lo"]).collect())
    pdf = odd.where("doc_id <> 11 or doc_id is null").toPandas()
    assert got == sorted(x[1:] for x in expected_removal(enumerate(pdf["text"])))
    assert substring.repeated_substrings(none)[1].count() == 0


def test_op5_index_grows_and_reopens(spark, tmp_path):
    """Batch by batch, with the index opened anew for each: the result equals brute force over all so far; runs are compacted."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(240).toPandas()
    docs = pd.concat([docs, docs.iloc[:5].assign(doc_id=lambda d: -d["doc_id"] - 1)])  # copies in a later batch
    for k, part in enumerate(np.array_split(np.arange(len(docs)), 4), 1):
        index = substring.FingerprintIndex(spark, str(tmp_path), buckets=2, max_runs=2)
        rows = spark.createDataFrame(docs.iloc[part]).selectExpr("xxhash64(text) AS hi", "hash(text) AS lo", "text")
        index.ingest(rows)
        assert index.batches == k and len(index.tables["run"]) <= 2 and len(index.tables["texts"]) == k
        got = sorted((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in index.cut().collect() for _ in range(r.copies))
        assert got == sorted(x[1:] for x in expected_removal(docs.iloc[: part[-1] + 1].itertuples(index=False, name=None)))
    assert not spark.catalog.listTables()


def test_op5_fails_at_every_write(spark, tmp_path, monkeypatch):
    """A batch that fails at any of its writes, with and without compaction, leaves an index that opens, takes the batch again and equals brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).toPandas()
    docs = pd.concat([docs, docs.iloc[:4].assign(doc_id=lambda d: -d["doc_id"] - 1)])
    parts = [docs.iloc[p] for p in np.array_split(np.arange(len(docs)), 3)]
    rows = [spark.createDataFrame(p).selectExpr("xxhash64(text) AS hi", "hash(text) AS lo", "text") for p in parts]
    want = sorted(x[1:] for x in expected_removal(docs.itertuples(index=False, name=None)))
    write, commit = substring.Steps.write, substring.FingerprintIndex._commit
    for batch in (1, 2):  # the second has no compaction, the third has
        base = str(tmp_path / f"index{batch}")
        index = substring.FingerprintIndex(spark, base, buckets=2, max_runs=2)
        for r in rows[:batch]:
            index.ingest(r)
        at = failures = 0
        while True:
            left = [at]

            def failing(step, left=left):
                def run(*args, **kwargs):
                    left[0] -= 1
                    if left[0] < 0:
                        raise OSError("the disk is gone")
                    return step(*args, **kwargs)

                return run

            monkeypatch.setattr(substring.Steps, "write", failing(write))
            monkeypatch.setattr(substring.FingerprintIndex, "_commit", failing(commit))
            index = index if at % 2 else substring.FingerprintIndex(spark, base, buckets=2, max_runs=2)  # the same object, and one that opens the folder
            assert (index.batches, len(index.tables["texts"])) == (batch, batch)
            try:
                index.ingest(rows[batch])
                break
            except OSError:
                at, failures = at + 1, failures + 1
        assert failures >= (7 if batch == 1 else 9)
        monkeypatch.undo()
        index = substring.FingerprintIndex(spark, base, buckets=2, max_runs=2)
        for r in rows[batch + 1 :]:
            index.ingest(r)
        assert index.batches == 3
        got = sorted((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in index.cut().collect() for _ in range(r.copies))
        assert got == want


def test_op2_held_out_accuracy(spark, odd, none):
    got = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    m = got[got["held_out"]].merge(lab, on="doc_id")
    hit = (m["predicted"] == 1) & (m["toxic"] == 1)
    assert hit.sum() >= 0.8 * (m["toxic"] == 1).sum() and hit.sum() >= 0.9 * (m["predicted"] == 1).sum()
    labels = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert odd.select(toxicity.score_column(model).alias("s")).where("s is null").count() == 0
    assert none.select(toxicity.score_column(model)).count() == 0


def test_op2_score_is_the_sum_over_pairs():
    """The score against a plain sum over all pairs of a text's terms."""
    rng = np.random.default_rng(3)
    texts = [b"", "You ARE a fool, fool!".encode(), " ".join(f"w{i}" for i in range(300)).encode(), b"unknown", "é ü fool".encode()]
    slot = np.full(1 << toxicity.BITS, -1, dtype=np.int16)
    _, term = toxicity.terms_of(texts[1:3])
    known = np.unique(term)[::2]
    slot[known] = np.arange(len(known))
    w, v = rng.normal(size=len(known)), rng.normal(scale=0.1, size=(len(known), toxicity.FACTORS))
    got = toxicity.FactorizationMachine(-0.4, slot, w, v).score(texts)
    for k, t in enumerate(texts):
        at = sorted({int(slot[x]) for x in toxicity.terms_of([t])[1]} - {-1})
        z = -0.4 + sum(w[i] for i in at) + sum(float(v[i] @ v[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_op2_repeated_ids_and_labels(spark, monkeypatch):
    """Rows under one id don't break the bound; equal rows and several labels count once; labels of one kind give their share."""
    docs = spark.createDataFrame([(i % 20, f"text {i % 40} " + ("fool " * 3 if i % 20 < 5 else "fine day")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(20)] + [(3, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=12)
    got = docs.select("doc_id", toxicity.score_column(model).alias("s")).toPandas()
    assert got["s"].between(0, 1).all()
    free = toxicity.train(docs, labels)
    scores = docs.select("doc_id", toxicity.score_column(free).alias("s")).toPandas()
    assert scores[scores["doc_id"] < 5]["s"].min() > scores[scores["doc_id"] >= 5]["s"].max()
    assert toxicity.train(docs, labels.where("toxic = 0")).score([b"fool"])[0] < 0.01
    clash = docs.withColumns({c: F.lit(1) for c in ("key", "y", "term")})
    assert clash.select(toxicity.score_column(toxicity.train(clash, labels)).alias("s")).count() == 200


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)) < 0.5
    y = (x[:, 0] ^ x[:, 1]).astype(float)  # no additive weights tell these apart
    b, w, v = toxicity.fit(x, y, epochs=60, decay=0)
    z = b + x @ w + 0.5 * ((x @ v) ** 2 - x @ (v * v)).sum(1)
    assert ((z > 0) == (y > 0)).mean() > 0.97


def test_op3_is_the_library(spark, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    some = odd.toPandas()
    got = pieces.encode_pieces(odd, pieces.public_model()).toPandas()
    for t, r in zip(some["text"], got.itertuples(), strict=True):
        ids = lib.encode(t or "", add_eos=True)
        assert list(r.ids) == ids and r.decoded == lib.decode(ids)
        raw = (t or "").encode()
        if raw:
            assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    assert pieces.encode_pieces(none, pieces.public_model()).count() == 0


def test_character_map():
    """A compiled map with keys a -> A and ab -> x, built by hand: the longest prefix wins and every byte keeps its source."""
    units = [0] * 1024
    base = lambda off: off << 10
    units[0] = base(1)  # root at 0, children at 1 ^ label
    a = 1 ^ ord("a")
    units[a] = base(a ^ 512) | (1 << 8) | ord("a")
    units[512] = (1 << 31) | 0
    units[512 ^ ord("b")] = base((512 ^ ord("b")) ^ 768) | (1 << 8) | ord("b")
    units[768] = (1 << 31) | 2
    blob = (len(units) * 4).to_bytes(4, "little") + np.array(units, dtype="<u4").tobytes() + b"A\0xyz\0"
    out, source = pieces.CharacterMap(blob).normalise("aéabc".encode())
    assert out == "Aéxyzc".encode() and source.tolist() == [0, 1, 1, 3, 3, 3, 5, 6]


def test_op3_character_map_agrees_with_the_library(spark, tmp_path):
    """A model with a compiled character map: spans are the library's own, piece by piece."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.public_model(), "rb") as f:
        model.ParseFromString(f.read())
    rule = sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    for collapse in (False, True):
        model.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
        model.normalizer_spec.remove_extra_whitespaces = collapse
        path = tmp_path / f"{collapse}.model"
        path.write_bytes(model.SerializeToString())
        lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
        texts = ["\ufb01ne \u2460\u2461 \uff21\uff22\uff23 word", "\u00bd cup of \u212bngstrom", "e\u0301 cafe\u0301 \u337f x", "plain text", "  two  spaces ", "\uac00\u1100\u1161 \u3000wide", "", "\u2026 \u2122 \U0001f600"]
        got = pieces.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), str(path)).orderBy("doc_id").collect()
        for t, r in zip(texts, got, strict=True):
            want = lib.encode(t, return_type="proto").pieces
            assert list(r.ids) == [x.id for x in want] + [lib.eos_id()] and r.decoded == lib.decode(list(r.ids))
            assert pieces.CharacterMap(model.normalizer_spec.precompiled_charsmap).normalise(t.encode())[0] or not t
            for x, a, b in zip(want, r.starts, r.ends, strict=True):
                if not lib.is_byte(x.id):
                    assert t.encode()[a:b].decode() == x.surface, (t, x.piece)


def test_op3_query_is_the_library(spark):
    """The digests of the query for every text, and that its spans tile the bytes."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    for r in pieces.op3_pieces(spark, SF).collect():
        ids = lib.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.spans_tile, r.source_bytes) == (len(ids), True, len(docs[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_op4_shards(spark, odd, none):
    got = sharding.op4_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    g = got.groupby("shard")["size"].sum()
    assert len(got) == len(docs) and len(g) == 24 and g.max() < 1.1 * g.mean() and g.min() > 0.9 * g.mean()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    m = got.merge(docs, on="doc_id")
    assert (m["size"] == [len(t.encode()) + 8 for t in m["text"]]).all()
    assert sharding.kd_shards(odd, 3).count() == odd.count() and sharding.kd_shards(none).count() == 0
    hot = spark.createDataFrame([(i, "same" * 50 if i % 3 == 0 else words(50, f"d{i}"), "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    sums = sharding.kd_shards(hot, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sums) == 8 and sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()


def test_op4_equal_texts_stay_together(spark):
    got = sharding.op4_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    assert got.merge(docs, on="doc_id").groupby("text")["shard"].nunique().max() == 1
    # groups of up to nine tenths of a leaf, ties in every dimension, and one that no leaf can hold
    rows = [(f"g{g} " + words(60, "x"), n) for g, n in enumerate((90, 85, 80, 60, 50, 40))] + [("huge " + words(60, "x"), 260)] + [(f"s{i} " + words(60, "x"), 1) for i in range(1000)]
    flat = [(i, t) for i, t in enumerate(t for t, n in rows for _ in range(n))]
    hot = spark.createDataFrame([(i, t, "en", "s") for i, t in flat], "doc_id long, text string, lang string, source string")
    out = sharding.kd_shards(hot, 16).join(hot.select("doc_id", "text"), "doc_id").toPandas()
    spread = out.groupby("text")["shard"].nunique()
    assert spread.drop(flat[-1001][1]).max() == 1 and spread.max() >= 2
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() < 1.04 * sums.mean() and sums.min() > 0.96 * sums.mean()


def test_op4_cuts_the_widest_dimension(spark):
    """Two shards: a cut at the weighted median of the dimension that is widest."""
    rows = [(i * 10**6, words(1 + i % 7, "w") + str(i), "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(docs, 2).toPandas()
    assert (got[got["shard"] == 0]["doc_id"].max() < got[got["shard"] == 1]["doc_id"].min()) or (got[got["shard"] == 0]["size"].max() <= got[got["shard"] == 1]["size"].min())
    names = spark.createDataFrame([(f"id{i}", t, None, None) for i, t, *_ in rows], "doc_id string, text string, lang string, source string")
    assert sharding.kd_shards(names, 3).count() == 400


def test_op6_matches_sql(spark, odd, none):
    assert_same(mixing.op6_mixing(spark, SF).toPandas(), tables(), mixing.SQL)
    clash = odd.withColumns({c: F.lit(1) for c in ("p", "topic", "tokens", "probability", "draw", "row", "mix_source")})
    out = mixing.mix(clash)
    assert out.select("row.*").columns == clash.columns and mixing.mix(none).count() == 0
    got = {r["row"]["doc_id"]: r for r in mixing.mix(odd, mixing.Targets(keep=1.0)).collect()}
    assert got[1]["tokens"] == 0 and got[3]["topic"] == "other"


def test_op6_topic_is_of_the_whole_text(spark):
    """The votes of all words, against a count in plain Python; the first word alone doesn't decide."""
    import regex

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = docs.select("text", mixing.topic_of(F.col("text")).alias("topic")).toPandas()
    for t, topic in got.itertuples(index=False):
        votes = [0] * mixing.TOPICS
        for w in {x.lower() for x in regex.findall(r"\p{L}{5,}", t)}:
            votes[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % mixing.TOPICS] += 1
        assert topic == (str(votes.index(max(votes))) if any(votes) else "other")


def greatest_share(cells, t):
    """The greatest share of tokens, in steps of a hundredth, at which probabilities up to 1 can meet all targets to 0.001."""
    cells = {c: n for c, n in cells.items() if n}
    n, margins = np.array(list(cells.values()), dtype=float), mixing.goals(cells, t)
    for keep in np.arange(t.keep, 0, -0.01):
        p = np.full(len(n), keep)
        for _ in range(300):
            for i, goal in enumerate(margins):
                for k, share in goal.items():
                    mine = np.array([c[i] == k for c in cells])
                    p[mine] = np.minimum(1, p[mine] * share * keep * n.sum() / (n * p)[mine].sum())
        if all(abs((n * p)[[c[i] == k for c in cells]].sum() / (n * p).sum() - share) < 0.001 for i, goal in enumerate(margins) for k, share in goal.items()):
            return keep
    return 0.0


@pytest.mark.parametrize("hot", [0, 3])
def test_op6_margins_hold(spark, hot):
    """Expected and drawn shares against the targets, also with three rows of ten moved to one source."""
    t = mixing.Targets()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.withColumn("source", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < hot, "src0").otherwise(F.col("source")))
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("source", "lang", mixing.topic_of(text).alias("topic"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    cells = {(r[0] or "other", r[1] or "other", r[2]): r[3] for r in marked.groupBy("source", "lang", "topic").agg(F.sum("n")).collect()}
    chance = mixing.rake(cells, t)
    assert all(0 <= p <= 1 for p in chance.values())
    kept = sum(n * chance.get(c, 1.0) for c, n in cells.items()) / sum(cells.values())
    assert greatest_share(cells, t) - 0.03 < kept <= t.keep + 0.001
    assert all(abs(a - b) < 0.001 for margin in mixing.expected_shares(cells, chance, t) for a, b in margin.values())
    drawn = mixing.mix(docs).select("row.lang", "tokens").toPandas()
    share = drawn.groupby("lang")["tokens"].sum() / drawn["tokens"].sum()
    assert all(abs(share[k] - v) < 0.015 for k, v in t.lang.items())


def test_op6_impossible_targets():
    few = {("a", "x", "0"): 90, ("b", "y", "0"): 10}
    t = mixing.Targets(source={"a": 0.5, "b": 0.5}, lang={"x": 0.5, "y": 0.5}, topic={"0": 1.0})
    got = mixing.rake(few, t)
    assert got["b", "y", "0"] > 0.98 and 90 * got["a", "x", "0"] == pytest.approx(10, rel=0.03)
    # sources and languages that are the same rows cannot have different targets
    assert all(0 < p <= 1 for p in mixing.rake(few, mixing.Targets(source={"a": 0.5, "b": 0.5}, lang={"x": 0.8, "y": 0.2}, topic={"0": 1.0})).values())
    assert mixing.rake({}, t) == {} and mixing.rake({("a", "x", "0"): 0}, t) == {}


def test_op7_metrics(spark, odd, none):
    got = quality.quality(odd).toPandas()
    for t, r in zip(odd.toPandas()["text"], got.itertuples(), strict=True):
        t = t or ""
        w = t.encode().split()
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality(none).count() == 0
    real = quality.op7_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good = real[(real["quality"] == 1) & ~real["base_failed"]]
    assert good["kept"].mean() > 0.98


def test_op7_distances_match_brute_force(spark):
    """Both distances of every text to the reference of its language, computed plainly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = quality.quality(docs).toPandas().set_index("doc_id")
    pdf = docs.toPandas()
    failed = dict(got["base_failed"])
    names = ["space", "lower", "upper", "digit", "stop", "symbol", "other", "beyond"]

    def kind(c):
        if c > "\x7f":
            return "beyond"
        return "space" if c in " \t\n\v\f\r" else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "other"

    def terms(t):
        _, (h,) = hash_words([t.lower().encode()], 1, quality.PUNCTUATION)
        return Counter((h >> np.uint64(64 - quality.WORD_BITS)).tolist())

    def distance(p, q):
        m = (p + q) / 2
        h = lambda x: -sum(v * np.log2(v) for v in x if v)
        return max(0.0, h(m) - (h(p) + h(q)) / 2) ** 0.5

    refs = {}
    clean = pdf[[not failed[i] for i in pdf["doc_id"]]].drop_duplicates("text")
    for lang, texts in clean.groupby("lang")["text"]:
        chars, total = Counter(), Counter()
        for t in texts:
            chars.update(map(kind, t))
            total.update(terms(t))
        common = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]]
        share = np.array([total[w] for w in common] + [sum(total.values()) - sum(total[w] for w in common)]) / sum(total.values())
        refs[lang] = np.array([chars[n] for n in names]) / sum(chars.values()), common, share
    assert set(refs) == {"en", "de", "fr", "es"}
    for i, t, lang in pdf.itertuples(index=False):
        (ref, common, share), r, c, w = refs[lang], got.loc[i], Counter(map(kind, t)), terms(t)
        n, m = sum(c.values()), sum(w.values())
        char = distance(np.array([c[x] for x in names]) / n, ref) if n >= quality.MIN_CHARS else 0.0
        word = distance(np.array([w[x] for x in common] + [m - sum(w[x] for x in common)]) / m, share) if m >= quality.MIN_WORDS else 0.0
        assert r["nearest"] == lang and abs(r["char_distance"] - char) < 1e-6 and abs(r["word_distance"] - word) < 1e-6
        assert r["kept"] == (not r["base_failed"] and char <= quality.MAX_CHAR_DISTANCE and word <= quality.MAX_WORD_DISTANCE)


def test_op7_copies_do_not_shape_references(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("length(text) > 500 and lang = 'en'").limit(1)
    many = docs.unionByName(one.withColumn("doc_id", F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + 600)))))
    before, after = (quality.quality(d).toPandas().set_index("doc_id") for d in (docs, many))
    assert (before["word_distance"] - after.loc[before.index, "word_distance"]).abs().max() < 1e-9


def test_op7_catches_bad_rows(spark):
    """Labelled-bad rows that pass the base rules, which only the distances can catch."""
    sf = "/root/testdata/sf0.1"
    real = quality.op7_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    real = real[~real["base_failed"]]
    good, bad = real[real["quality"] == 1], real[real["quality"] == 0]
    assert (~bad["kept"]).mean() > 0.8 and good["kept"].mean() > 0.985
    assert (bad["word_distance"] > quality.MAX_WORD_DISTANCE).any() and (bad["char_distance"] > quality.MAX_CHAR_DISTANCE).any()


def test_op7_references(spark):
    """Junk under a language value of its own, under null and under a wrong one is compared with the real languages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    shout, signs = words(300, "x").upper(), "#$% " + "*** &&& <|> w " * 80 + words(100, "q")
    junk = [(-1, shout, "zz"), (-2, shout + " B", None), (-3, signs, None), (-4, signs + " c", "yy"), (-5, shout + " D", "en"), (-6, signs + " e", " ")]
    got = quality.quality(docs.unionByName(spark.createDataFrame(junk, docs.schema))).toPandas()
    mine = got[got["doc_id"] < 0]
    assert len(mine) == 6 and not mine["kept"].any() and set(got["nearest"]) == {"en", "de", "fr", "es"}
    # a real text keeps its place whatever its language says
    plain = docs.where("lang = 'en'").withColumn("lang", F.lit(None).cast("string")).limit(50)
    asis = quality.quality(docs).toPandas().set_index("doc_id")["kept"]
    dirty = quality.quality(docs.join(plain.select("doc_id"), "doc_id", "left_anti").unionByName(plain.select(docs.columns))).toPandas().set_index("doc_id")["kept"]
    assert (asis == dirty.reindex(asis.index)).mean() > 0.99
    # fewer texts than LEAST_TEXTS are no reference, however long
    few = spark.createDataFrame([(i, words(2000, f"t{i}"), "en") for i in range(quality.LEAST_TEXTS - 1)], docs.schema)
    assert quality.quality(few).toPandas()["nearest"].isna().all()


@pytest.mark.parametrize("block", [nearest.BLOCK, 500])
def test_op8_recall(spark, monkeypatch, block):
    """Against brute force, in one block and in several; few vectors are verified."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8 if block == 500 else nearest.QUERY_BLOCK)
    got = nearest.op8_nearest(spark, "/root/testdata/sf0.1").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = total = 0
    for q, r in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(r["vec_id"]))
        total += 10
        assert r.sort_values("rank")["score"].is_monotonic_increasing and sorted(r["rank"]) == list(range(1, 11))
    assert total == 200 and hit >= 0.97 * total
    # a block must first find its own ten, so small blocks verify more
    assert got.groupby("query_id")["verified"].first().mean() < (0.1 if block > 500 else 0.2) * len(ids)


def test_op8_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (5, [3.0, 0.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, row int")
    got = nearest.nearest(v, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    # every row but the query's own: both rows of id 5 are candidates
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 5, 1.0), (0, 4, 5, 2.0)]
    same = nearest.nearest(v.where("vec_id = 0").unionByName(v.where("vec_id = 0")), F.lit(True)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in same] == [(0, 1, 0, 0.0)] * 2
    assert nearest.nearest(v.limit(0), F.lit(True)).count() == 0


def test_op9_counts(spark, odd, none, tmp_path):
    """Files written and scanned again, against the encoder; then files with open ends, empty documents and blocks without an end."""
    model = pieces.public_model()
    want = pieces.encode_pieces(odd, model, outputs=("n_tokens",)).toPandas()
    tokenfiles.write_files(tokenfiles.token_rows(odd, model), 2, str(tmp_path / "odd"))
    scan = lambda path, n=64, segment=3: tokenfiles.count_tokens(tokenfiles.scan_blocks(tokenfiles.read_blocks(spark, path, block_ids=n), 2), segment)
    got = scan(str(tmp_path / "odd")).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")).join(tokenfiles.positions(odd), ["part", "position"]).toPandas()
    assert got["closed"].all() and sorted(zip(got["doc_id"].fillna(-1), got["n_tokens"], strict=True)) == sorted(zip(want["doc_id"].fillna(-1), want["n_tokens"], strict=True))
    assert len(set(got["part"])) > 1
    tokenfiles.write_files(tokenfiles.token_rows(none, model), 2, str(tmp_path / "none"))
    assert scan(str(tmp_path / "none")).count() == 0
    (tmp_path / "flat").mkdir()
    rng = np.random.default_rng(4)
    expected = {}
    for k in range(12):
        ids = rng.integers(2, 9 if k % 2 else 400, rng.integers(0, 900)).astype("<u2")
        name = tmp_path / "flat" / f"{k}.bin"
        name.write_bytes(ids.tobytes() + b"\x02" * (k % 2))  # an odd byte at the end is no id
        ends = np.flatnonzero(ids == 2)
        lengths = np.diff(ends, prepend=-1).tolist()
        rest = len(ids) - 1 - ends[-1] if len(ends) else len(ids)
        expected |= {(f"{k}.bin", i): (n, True) for i, n in enumerate(lengths)} | ({(f"{k}.bin", len(lengths)): (rest, False)} if rest else {})
    for block, segment in ((16, 1), (16, 4), (5, 1000), (10_000, 3)):
        rows = scan(str(tmp_path / "flat" / "*.bin"), block, segment).collect()
        assert {(r.file.rsplit("/", 1)[1], r.position): (r.n_tokens, r.closed) for r in rows} == expected and len(rows) == len(expected)


def test_op9_query(spark):
    got, want = tokenfiles.op9_token_counts(spark, SF).toPandas(), pieces.op3_pieces(spark, SF).toPandas()
    assert sorted(zip(got["doc_id"], got["n_tokens"], strict=True)) == sorted(zip(want["doc_id"], want["n_tokens"], strict=True))
    with pytest.raises(ValueError):
        tokenfiles.write_files(spark.createDataFrame([(b"",)], "data binary"), 50256, "/nowhere")


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<br>b<p>c &amp; d &lt;x&gt;<div class='ad'>x</div> e", ["a b", "c & d <x>", "e"]),
        ("<article><header>H</header><h1>T</h1><p>x</article><div class='comments'>q</div>", ["T", "x"]),
        ("<div id=cookie-notice>c</div><main><p>m  <i>n</i></p><form>f</form></main><aside>s</aside>", ["m n"]),
        ('<div><script>var a="</p><p>";</script>k</div>', ["k"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>x", ["a", "b", "c", "x"]),
        ("a < b <p>un<b>closed", ["a < b", "unclosed"]),
        ("<div hidden>x</div>y<!-- z -->w", ["yw"]),
    ],
)
def test_op10_pages(page, blocks):
    assert [b for b, _, ruled in html.blocks_of(page) if not ruled] == blocks


def test_op10_site_template(spark):
    rows = [(i, f"http://H.example/{i}", f"<article><div>Read this everywhere</div><p>text {i}</p></article>") for i in range(6)]
    rows += [(7, "http://other.example/", "<article><div>Read this everywhere</div><p>own</p></article>"), (8, None, None), (9, "http://h.example/9", "<article><div>Read this everywhere</div></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", __import__("pyspark").sql.functions.lit(1))
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: f"text {i}" for i in range(6)} | {7: "Read this everywhere\nown", 8: "", 9: "Read this everywhere"}
    assert html.extract(pages.limit(0)).count() == 0
    real = html.op10_html(spark, SF).toPandas()
    docs = {"\n".join(x for x in (" ".join(p.split()) for p in t.split("\n")) if x) for t in spark.read.parquet(f"{SF}/documents.parquet").toPandas()["text"]}
    assert all(t.split("\n", 1)[1] in docs for t in real["text"]) and (real["n_chars"] == real["text"].str.len()).all()


def test_op10_counts_the_whole_page(spark):
    """Menus, footers and notices that no rule names are deleted by counting, whatever their attributes; of a single page they are not."""
    shell = "<body><div id='x{i}'><ul><li><a href='/{i}'>Home</a><li>Contact us</ul></div><article><h1>Title {i}</h1><p>text {i}</article><section class='s{i}'><p>All rights reserved</section></body>"
    rows = [(i, f"http://a.example/{i}", shell.format(i=i)) for i in range(8)] + [(9, "http://b.example/", shell.format(i=9))]
    # without an article the body is the main part, and only counting can tell
    rows += [(20 + i, f"http://c.example/{i}", f"<div><p>Our shop</p><p>Call now</p></div><h1>T {i}</h1><p>own {i}</p><div data-n={i}><p>Imprint</p></div>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_template) for r in html.extract(pages).collect()}
    assert got[3] == ("Title 3\ntext 3", 3) and got[9] == ("Title 9\ntext 9", 0) and got[22] == ("T 2\nown 2", 3)


def test_op10_counts_match_brute_force(spark):
    """Template subtrees of real pages, counted plainly from the same blocks."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r["host"], r["hash"]): r["main"] for r in html.templates(html.parsed(pages)).collect()}
    seen, n = Counter(), Counter()
    for host, page in pages.select(html.host_of(F.col("url")), "html").toPandas().itertuples(index=False):
        n[host] += 1
        seen.update({(host, h) for _, path, _ in html.blocks_of(page) for h in path})
    want = {k: c >= html.MAIN_SHARE * n[k[0]] for k, c in seen.items() if c >= html.MIN_PAGES and c >= html.MIN_SHARE * n[k[0]]}
    assert got == want and len(want) > 0
    out = html.extract(pages).toPandas()
    assert out["n_template"].sum() > 0
