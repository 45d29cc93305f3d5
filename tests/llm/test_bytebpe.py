"""Byte-level BPE against the tiktoken library: real texts, every kind of character, long runs, odd and empty tables."""

import base64
import hashlib
import random

import pytest
import tiktoken

from oreline.llm import bytebpe
from tests.llm.test_operators import none, odd  # noqa: F401
from tests.oracle import SF

PATH, PATTERN = bytebpe.public_ranks()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    r = random.Random(1)
    runs = ["a" * 3000, "=" * 9000, " " * 3001, "ab" * 2000, "\n" * 999 + "x", "aaaaab" * 700, "".join(r.choice("abcdefghij") for _ in range(700))]
    mixed = ["".join(r.choice("ab=- \n'") for _ in range(r.randint(0, 60))) for _ in range(500)]
    wide = ["x".join(chr(r.randrange(0x20, 0x2FA20)) for _ in range(40)) for _ in range(100)]
    odd_ones = ["", "<|endoftext|> x", "  \n\n\t x'll don't I'M 12 ½ \x1c\x85\u180e\u2028", "é😀 ▁x  y\n\nz"]
    return runs + mixed + ["".join(c for c in w if not 0xD800 <= ord(c) < 0xE000) for w in wide] + odd_ones


def test_equals_the_library(library):
    texts = some_texts()
    c = bytebpe.BpeCodec(PATH, PATTERN)
    got = c.encode_many(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert c.decode_many(got) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        c.decode_many([got[0], got[0][:1] + 10**6])


def test_long_and_short_words_alike(monkeypatch):
    """Contracting every place of a pair at once, or the leftmost alone, gives the same ids."""
    texts = some_texts()[6:60]
    out = []
    for limit in (0, 10**9):
        monkeypatch.setattr(bytebpe, "LONG_WORD", limit)
        out.append([x.tolist() for x in bytebpe.BpeCodec(PATH, PATTERN).encode_many(texts)])
    assert out[0] == out[1]


def test_blocks_and_a_small_cache(monkeypatch, library):
    monkeypatch.setattr(bytebpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bytebpe, "WORD_BYTES", 7)
    monkeypatch.setattr(bytebpe, "BLOCK_IDS", 5)
    c, texts = bytebpe.BpeCodec(PATH, PATTERN), ["one two three four five six seven", "", "nine é😀 words"]
    for _ in range(2):
        got = c.encode_many(texts)
        assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts] and c.decode_many(got) == [t.encode() for t in texts]


def test_op11(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in docs.itertuples(index=False):
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.op11_byte_bpe(spark, SF).collect()} == want


def test_op11_odd_rows(spark, odd, none, library):  # noqa: F811
    got = bytebpe.encode_bytes(odd, PATH, PATTERN, outputs=("ids", "decoded"))
    rows = sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids), bytes(r.decoded)) for r in got.collect())
    assert rows == sorted((r.doc_id is None, r.doc_id or 0, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd.collect())
    back = bytebpe.decode_bytes(got.selectExpr("doc_id", "CASE WHEN doc_id = 5 THEN NULL ELSE ids END AS ids"), PATH, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect() if r.doc_id in (5, 6)} == {5: b"", 6: next(d for _, i, _, d in rows if i == 6)}
    assert bytebpe.encode_bytes(none, PATH, PATTERN).count() == 0
