"""SentencePiece encoding and decoding that keeps byte offsets.

Method.  A text is normalised by longest-prefix replacement through the
model's compiled character map (a double-array trie and a table of
replacements; empty for an identity model), while the source offset of every
normalised byte is recorded.  The pieces of the normalised text are then
projected through that alignment to spans of bytes of the original text.

A model without a map, as the public one, has an identity map: the alignment is
then that of the space marks alone, through the same code.

Speed.  A piece never crosses a place where white space follows something
else, nor touches a character that only occurs as a piece of its own, if the
vocabulary has no such piece.  Where this holds (it is tested on the
vocabulary), units between such places are encoded once and remembered; the
library encodes each new unit.  Where it does not hold, or for a model whose
normaliser does more than mark spaces, whole texts go to the library.

Defined cases.  Null is empty: no piece besides the end id, decoded to an empty
text.  Lone surrogates become '?'.  Only the text and id columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries
from .substring import chunks

SPACE_MARK = "▁"
CACHE_UNITS = 700_000


class CharacterMap:
    """The compiled character map of a model: longest-prefix replacement of UTF-8 byte strings."""

    def __init__(self, blob: bytes):
        self.units = self.table = None
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.table = blob[4 + size :]

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, offset of the replacement) of the longest key that starts at ``at``; length 0 if none does."""
        units, node, best = self.units, 0, (0, 0)
        step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node ^= step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= step(unit)
            if (unit >> 8) & 1:
                best = (i + 1 - at, units[node] & ((1 << 31) - 1))
        return best

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The replaced text, and for each of its bytes and its end the offset of the source it comes from."""
        if self.units is None:
            return data, np.arange(len(data) + 1)
        out, source, at = [], [], 0
        while at < len(data):
            size, offset = self._longest(data, at)
            if size:
                new = self.table[offset : self.table.index(b"\0", offset)]
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + size]
            out.append(new)
            source += [at] * len(new)
            at += size
        return b"".join(out), np.array([*source, len(data)])


def mark_spaces(data: bytes, source: np.ndarray, prefix: bool, collapse: bool) -> tuple[bytes, np.ndarray]:
    """Spaces as marks, with a leading mark for ``prefix``; ``collapse`` drops leading, trailing and repeated spaces.  Keeps the alignment."""
    if not data:
        return data, source
    buf = np.frombuffer(data, dtype=np.uint8)
    keep = np.ones(len(buf), dtype=bool)
    blank = buf == 0x20
    after = source[-1:]
    if collapse:
        keep = ~blank | np.concatenate([[False], ~blank[:-1]])
        last = np.flatnonzero(~blank)
        kept = last[-1] + 1 if len(last) else 0
        keep[kept:] = False
        after = source[kept : kept + 1]
    size = np.where(blank, 3, 1)[keep]
    at = source[:-1][keep]
    marked = data.replace(b" ", SPACE_MARK.encode()) if keep.all() else bytes(buf[keep]).replace(b" ", SPACE_MARK.encode())
    spread = np.repeat(at, size)
    head = [at[0]] * 3 if prefix and len(at) else []
    return (SPACE_MARK.encode() if prefix and len(at) else b"") + marked, np.concatenate([np.array(head, dtype=np.int64), spread, after]).astype(np.int64)


class PieceCodec:
    """Encodes and decodes exactly as the sentencepiece library does with the model file at ``path``."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map, self.prefix, self.collapse = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.whole.eos_id()
        pieces = [(p.piece, p.type) for p in model.pieces]
        # bytes of normalised text that each piece stands for; a byte piece stands for one
        self.length = np.array([1 if kind == 6 else 0 if kind == 3 else len(p.encode()) for p, kind in pieces], dtype=np.int64)
        # bytes that each piece is decoded to, which are those of its source where the map changes nothing
        self.odd = np.array([kind in (2, 3) for _, kind in pieces])
        surface = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind in (2, 3) else p.replace(SPACE_MARK, " ").encode() for p, kind in pieces]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.width = np.array([len(x) for x in surface], dtype=np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.unknown = self.whole.unk_id()
        words = [p for p, kind in pieces if kind in (1, 4, 5)]
        crossing = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in words)
        self.by_unit = not (crossing or self.map.units or self.collapse or not spec.escape_whitespaces or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or any(kind == 4 for _, kind in pieces) or not model.trainer_spec.byte_fallback)
        self.lines = not any("\n" in p for p in words)
        spec.add_dummy_prefix = False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.units = re.compile("\n+[^ \n]*| *[^ \n]+| +" if self.lines else " *[^ ]+| +")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids without the end id."""
        return self.encode_many([text])[0]

    def _split(self, text: str) -> list[str]:
        if SPACE_MARK in text:  # the library treats the mark as a space
            text = text.replace(SPACE_MARK, " ")
        if not text:
            return []
        if not self.lines or "  " in text or text[0] == " " or not self.prefix:
            units = self.units.findall(" " + text if self.prefix else text)
            return [u[1:] if u[0] == " " and u[1:2] not in ("", " ") else u for u in units] if self.prefix else units
        # "word" stands for " word"; a unit that begins with a new line has no space before it
        return text.replace("\n", " \n").split(" ")

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids without the end id, of each text."""
        if not self.by_unit:
            return [np.array(x, dtype=np.int32) for x in self.whole.encode(texts, num_threads=1)]
        known = self.known
        if len(known) > CACHE_UNITS:
            known.clear()
        units = [self._split(t) for t in texts]
        parts = [list(map(known.get, u)) for u in units]
        new = list({x for u, p in zip(units, parts, strict=True) if None in p for x, y in zip(u, p, strict=True) if y is None})
        if new:
            spelt = [u if u and u[0] in " \n" else " " + u for u in new] if self.prefix else new
            for u, ids in zip(new, self.raw.encode(spelt, num_threads=1), strict=True):
                known[u] = array("i", ids).tobytes()
            parts = [[known[x] if y is None else y for x, y in zip(u, p, strict=True)] if None in p else p for u, p in zip(units, parts, strict=True)]
        return [np.frombuffer(b"".join(p), dtype=np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids).

        Known pieces and the end id are looked up in a table of bytes.  The library itself decodes ids
        with other control or unknown pieces, or whose byte pieces don't make up UTF-8.
        """
        ids = ids[:-1] if len(ids) and ids[-1] == self.end else ids
        if self.by_unit and len(ids) and not self.odd[ids].any():
            size = self.width[ids]
            ends = np.cumsum(size)
            at = np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1])
            data = self.surface[at].tobytes()
            if self.prefix and data[:1] == b" ":
                data = data[1:]
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        return self.whole.decode(ids.tolist())

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece starts and ends in the UTF-8 bytes of the original text."""
        data, source = self.map.normalise(text.encode("utf-8", "replace"))
        marked, source = mark_spaces(data, source, self.prefix, self.collapse)
        size = self.length[ids]
        if (ids == self.unknown).any():
            # an unknown piece stands for the characters between its known neighbours
            return self._unknown_spans(marked, source, ids)
        at = np.concatenate([[0], np.cumsum(size)])
        return source[at[:-1]], source[at[1:]]

    def _unknown_spans(self, marked: bytes, source: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, starts, ends = 0, [], []
        for k, i in enumerate(ids.tolist()):
            size = int(self.length[i])
            if i == self.unknown:
                after = next((self.whole.id_to_piece(j).encode() for j in ids[k + 1 :].tolist() if j != self.unknown), None)
                size = (marked.find(after, at) if after else len(marked)) - at
            starts.append(at)
            at += max(size, 0)
            ends.append(at)
        return source[np.array(starts, dtype=np.int64)], source[np.array(ends, dtype=np.int64)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec a worker process."""
    return PieceCodec(path)


_DIGITS = np.char.add(np.arange(100_000).astype("S5"), b" ").astype("S8").view(np.uint64)


def decimal_ids(ids: np.ndarray) -> bytes:
    """Decimal ids joined by one space."""
    if not len(ids):
        return b""
    if int(ids.max()) >= len(_DIGITS):
        return " ".join(map(str, ids.tolist())).encode()
    wide = _DIGITS.take(ids).view(np.uint8)
    return wide[wide != 0].tobytes()[:-1]


OUTPUTS = {
    "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string",
    "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "source_bytes": "long", "spans_tile": "boolean",
}


def _encoded(c: PieceCodec, texts: list[bytes]):
    """(bytes, text, ids) of each text, some megabytes at a time."""
    for a, b in chunks(texts, 2 << 20):
        whole = [x.decode("utf-8", "replace") for x in texts[a:b]]
        yield from zip(texts[a:b], whole, c.encode_many(whole), strict=True)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded")) -> DataFrame:
    """(doc_id, outputs...) of every row: ids with the end id last, spans of bytes for all but the end id, the decoded text, or digests of them.

    spans_tile: the spans follow each other without a gap and cover the text's source_bytes from the first to the last.
    """

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in outputs}
            for raw, text, ids in _encoded(c, binaries(batch.column("text"))):
                full = np.append(ids, np.int32(c.end))
                row: dict = {}
                if {"starts", "ends", "spans_tile"} & set(outputs):
                    start, end = c.spans(text, ids)
                    row |= {"starts": start.astype(np.int32), "ends": end.astype(np.int32)}
                    row["spans_tile"] = bool((len(ids) == 0 and not raw) or (len(ids) and start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()))
                if {"decoded", "decoded_sha256"} & set(outputs):
                    row["decoded"] = c.decode(full)
                    row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode("utf-8", "replace")).hexdigest()
                if "ids_sha256" in outputs:
                    row["ids_sha256"] = hashlib.sha256(decimal_ids(full)).hexdigest()
                row |= {"ids": full, "n_tokens": len(full), "source_bytes": len(raw)}
                for k in outputs:
                    out[k].append(row[k])
            kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], kinds[OUTPUTS[k]]) for k in outputs)], ["doc_id", *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, public_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "source_bytes", "spans_tile"))
