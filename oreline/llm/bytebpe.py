"""Byte-level BPE encoding and decoding by DuckDB queries inside the tasks.

Method.  A text is split by the pattern, and each match is a word of its own.
In every task DuckDB holds the merge table: a row for every two tokens whose
bytes together are a token, with that token's rank.  Words enter as rows (word,
position, token), at first one for each byte.  A recursive query joins each row
and its right neighbour with the merge table, contracts each word's leftmost
pair of the least rank, and hands words that still have a pair to the next
round, until none has.  Decoding joins (text, position, id) with the
vocabulary and aggregates the bytes in order of position.

Two things keep rounds few and leave results as they are.  A word that is a
token as a whole takes that token, as in the library.  Where no pair with the
new token could have a lower rank than the token itself (the merge table says
so), the rounds for the same pair further right come next anyhow, so all its
places in a long word, from left to right without overlap, are contracted in one
round.

Spark deals texts over tasks; a task takes some megabytes at a time and
remembers words that it has encoded.  A text is never cut for encoding; ids are
decoded in blocks, so memory follows the longest text, not the table.  The
work on a single word grows with its length times the distinct merges it takes.

Defined cases.  Null is empty: no ids, decoded to nothing.  Bytes that are no
UTF-8 become U+FFFD.  Strings of special tokens are ordinary text.  Repeated
rows are encoded each; an empty table gives no rows.  Only the id and text
columns are read.  Decoding takes null ids for none and fails on an id that the
vocabulary hasn't.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, kind_of
from .pieces import decimal_ids
from .substring import chunks

CACHE_WORDS, LONG_WORD = 800_000, 64
#: Bytes of new words in one recursive query, ids in one ordered aggregation, bytes of text encoded at a time.
WORD_BYTES, BLOCK_IDS, TEXT_BYTES = 1 << 19, 1 << 19, 2 << 20

_MERGES = """
CREATE TABLE merges AS
WITH pairs AS (
  SELECT l.id AS l, r.id AS r, whole.id AS rank
  FROM (SELECT id, bytes, unnest(range(1, octet_length(bytes))) AS cut FROM vocab) whole
  JOIN vocab l ON l.bytes = whole.bytes[1:whole.cut] JOIN vocab r ON r.bytes = whole.bytes[whole.cut + 1:]
), low AS (
  SELECT token, min(rank) AS rank FROM (SELECT l AS token, rank FROM pairs UNION ALL SELECT r, rank FROM pairs) GROUP BY token
)
SELECT p.l, p.r, p.rank, coalesce(low.rank > p.rank, true) AS everywhere FROM pairs p LEFT JOIN low ON low.token = p.rank
"""

_ROUNDS = """
WITH RECURSIVE step AS (
  SELECT s.word, s.pos, coalesce(w.whole, s.tok) AS tok, w.whole IS NULL AS live
  FROM start s JOIN whole w USING (word) WHERE w.whole IS NULL OR s.pos = w.first_pos
  UNION ALL
  {contract}
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""

#: The leftmost pair of the least rank: ``low`` is its rank and place in one number, ``gone`` the place of its right half.
_ENCODE = _ROUNDS.format(contract="""(
  WITH placed AS MATERIALIZED (
    SELECT p.word, p.pos, p.tok, p.next_pos, m.rank * 4294967296 + p.pos AS key
    FROM (SELECT word, pos, tok, lead(tok) OVER w AS next, lead(pos) OVER w AS next_pos FROM step WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)) p
    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next
  ), best AS (
    SELECT word, min(key) AS low, arg_min(next_pos, key) AS gone FROM placed GROUP BY word
  )
  SELECT word, pos, CASE WHEN pos = low % 4294967296 THEN low // 4294967296 ELSE tok END, low IS NOT NULL
  FROM placed JOIN best USING (word) WHERE gone IS NULL OR pos <> gone
  )""")

#: The same for long words, with every place of the pair: of adjoining places the first, third, ...; only the leftmost where a lower pair could arise.
_ENCODE_LONG = _ROUNDS.format(contract="""
  SELECT word, pos, CASE WHEN taken THEN best ELSE tok END, best IS NOT NULL
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
    FROM (
      SELECT word, pos, tok, best, hit AND CASE WHEN everywhere THEN (idx - first_value(idx) OVER run) % 2 = 0 ELSE pos = min(pos) FILTER (WHERE hit) OVER (PARTITION BY word) END AS taken
      FROM (
        SELECT *, CASE WHEN hit THEN idx - count(*) FILTER (WHERE hit) OVER (PARTITION BY word ORDER BY pos) END AS island
        FROM (
          SELECT *, coalesce(rank = best, false) AS hit
          FROM (
            SELECT p.*, m.rank, m.everywhere, min(m.rank) OVER (PARTITION BY word) AS best
            FROM (SELECT word, pos, tok, lead(tok) OVER placed AS next, row_number() OVER placed AS idx FROM step WHERE live WINDOW placed AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next
          )
        )
      )
      WINDOW run AS (PARTITION BY word, island ORDER BY pos)
    )
  )
  WHERE NOT eaten""")

_DECODE = "SELECT block, string_agg(v.latin, '' ORDER BY i.pos) AS latin, count(v.id) AS known FROM ids i LEFT JOIN vocab v ON v.id = i.id GROUP BY block ORDER BY block"


class BpeCodec:
    """Encodes and decodes as the tiktoken library does with the ranks file at ``path`` and the pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        # bytes as the first 256 characters, so that they can be aggregated as text
        self._table("given", id=pa.array(list(ranks.values()), pa.int32()), bytes=pa.array(list(ranks), pa.binary()), latin=[t.decode("latin-1") for t in ranks])
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.con.execute(_MERGES)
        self.con.unregister("given")
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, **columns) -> None:
        self.con.register(name, pa.table(columns))

    def _words(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """Ids of each word, by one recursive query."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        end = np.cumsum(size)
        self._table("given", word=np.arange(len(words), dtype=np.int32), first_pos=end - size, bytes=pa.array(words, pa.binary()))
        self._table("start", word=np.repeat(np.arange(len(words), dtype=np.int32), size), pos=np.arange(size.sum()), tok=self.first[np.frombuffer(b"".join(words), dtype=np.uint8)])
        self.con.execute("CREATE OR REPLACE TEMP TABLE whole AS SELECT g.word, g.first_pos, v.id AS whole FROM given g LEFT JOIN vocab v USING (bytes)")
        ids = self.con.sql(query).to_arrow_table().column("ids").combine_chunks()
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, words = self.known, [self.split(t) for t in texts]
        new: dict[bool, list[str]] = {False: [], True: []}
        for w in {w: None for ws in words for w in ws if w not in known}:
            new[len(w) > LONG_WORD].append(w)
        for long, some in new.items():
            spelt = [w.encode("utf-8", "replace") for w in some]
            for a, b in chunks(spelt, WORD_BYTES):
                for w, ids in zip(some[a:b], self._words(spelt[a:b], _ENCODE_LONG if long else _ENCODE), strict=True):
                    known[w] = ids.tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype=np.int32) for ws in words]

    def _joined(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Bytes of each block of ids, by one ordered aggregation."""
        flat = np.concatenate(blocks).astype(np.int32)
        self._table("ids", block=np.repeat(np.arange(len(blocks), dtype=np.int32), [len(x) for x in blocks]), pos=np.arange(len(flat), dtype=np.int32), id=flat)
        got = self.con.sql(_DECODE).to_arrow_table()
        if sum(got.column("known").to_pylist()) != len(flat):
            raise ValueError("an id is not in the vocabulary")
        return [x.encode("latin-1") for x in got.column("latin").to_pylist()]

    def decode_many(self, texts: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; a long list is decoded in blocks."""
        blocks = [(k, x[i : i + BLOCK_IDS]) for k, x in enumerate(texts) for i in range(0, len(x), BLOCK_IDS)]
        out: list[list[bytes]] = [[] for _ in texts]
        for a, b in chunks([x for _, x in blocks], BLOCK_IDS):
            for (k, _), data in zip(blocks[a:b], self._joined([x for _, x in blocks[a:b]]), strict=True):
                out[k].append(data)
        return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    """One codec a worker process."""
    return BpeCodec(path, pattern)


_KINDS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string())}


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, outputs...) of every row: ids, their number, the decoded bytes, or digests of both."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts, out = binaries(batch.column("text")), {k: [] for k in outputs}
            for a, b in chunks(texts, TEXT_BYTES):
                ids = c.encode_many([t.decode("utf-8", "replace") for t in texts[a:b]])
                decoded = c.decode_many(ids) if {"decoded", "decoded_sha256"} & set(outputs) else []
                made = {"ids": lambda ids=ids: ids, "n_tokens": lambda ids=ids: map(len, ids), "ids_sha256": lambda ids=ids: (hashlib.sha256(decimal_ids(x)).hexdigest() for x in ids)}
                made |= {"decoded": lambda d=decoded: d, "decoded_sha256": lambda d=decoded: (hashlib.sha256(x).hexdigest() for x in d)}
                for k in outputs:
                    out[k] += made[k]()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], _KINDS[k][1]) for k in outputs)], ["doc_id", *outputs])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind_of(docs, id_col)}, " + ", ".join(f"{k} {_KINDS[k][0]}" for k in outputs))


def decode_bytes(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that each row's array of ids stands for."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c.decode_many(lists), pa.binary())], ["doc_id", "decoded"])

    given = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return given.mapInArrow(run, f"doc_id {kind_of(rows, id_col)}, decoded binary")


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_bytes(docs, *public_ranks(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
