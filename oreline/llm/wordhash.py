"""Vectorised word hashing over UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, newline, vertical tab,
form feed and carriage return, exactly the pattern ``[^\\x20\\x09-\\x0D]+``.
A word is read as blocks of eight bytes, each mixed into its 64-bit hash; all
words of a piece take a step at once, so the cost is a few array operations per
word and no Python object per word.  Texts are handled in pieces of a megabyte
cut at white space; memory stays bounded however long one text is.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

PIECE_BYTES, LONG_WORD = 1 << 20, 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CUT = re.compile(rb"[\x20\x09-\x0D]")
#: A start and a multiplier of each lane.
_LANES = ((0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD), (0xC2B2AE3D27D4EB4F, 0xC4CEB9FE1A85EC53))
_JOIN = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: The bytes of a block that belong to a word of which 0 .. 8 bytes are left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: bytes, wide: np.ndarray, start: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
    """A hash of each data[start : start + size]; ``wide`` has the eight bytes from every offset on."""
    seed, factor = map(np.uint64, _LANES[lane])
    h = mix((wide[start] & _MASK[np.minimum(size, 8)]) * factor + (size.astype(np.uint64) ^ seed))
    todo, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(todo):
        block = wide[start[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
        h[todo] = mix((h[todo] ^ block) * factor + seed)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]], seed=int(seed))
    return h


def _pieces(texts: list[bytes]):
    """(index of the first text, parts) with parts of about PIECE_BYTES; a long text is cut at white space."""
    part: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            if part:
                yield first, part
            part, size = [], 0
            at = 0
            while at < len(text):
                cut = _CUT.search(text, min(at + PIECE_BYTES, len(text)))
                end = cut.start() + 1 if cut else len(text)
                yield i, [text[at:end]]
                at = end
            first = i + 1
            continue
        if size + len(text) > PIECE_BYTES:
            yield first, part
            part, size, first = [], 0, i
        part.append(text)
        size += len(text)
    if part:
        yield first, part


#: Everything in ASCII but letters and digits; words between these are free of punctuation.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_bounds(data: bytes, size: int, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the first ``size`` bytes starts and ends."""
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = ~separators[np.frombuffer(data, dtype=np.uint8, count=size)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hash_words(texts: list[bytes], lanes: int = 1, separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text (as offsets of length len(texts) + 1) and, for each lane, one hash per word.

    Lanes are independent hash functions; after them come the hashes of the first so many bytes (8 at
    most) of each word, for each of ``prefixes``.  Empty texts have no words.
    """
    counts = np.zeros(len(texts), dtype=np.int64)
    out: list[list[np.ndarray]] = [[] for _ in range(lanes + len(prefixes))]
    for first, part in _pieces(texts):
        data = b"\n".join([*part, bytes(8)])
        start, end = word_bounds(data, len(data) - 9, separators)
        if not len(start):
            continue
        ends = np.cumsum([len(x) + 1 for x in part])
        counts[first : first + len(part)] += np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(part))[: len(part)]
        wide = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = end - start
        for lane in range(lanes):
            out[lane].append(_hashes(data, wide, start, size, lane))
        for k, most in enumerate(prefixes):
            out[lanes + k].append(mix(_hashes(data, wide, start, np.minimum(size, most), 0) + np.uint64(most)))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return offsets, [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in out]


def window_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """One hash for each run of ``size`` consecutive words (none if there are fewer words), by doubling as in ``sliding``."""
    factor = np.uint64(_JOIN[lane])
    return sliding(words, size, lambda a, b: mix(a * factor + b)) if size > 1 else mix(words)


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over each run of ``width`` values, by doubling: about log2(width) passes."""
    have, out = 1, values
    if len(values) < width:
        return values[:0]
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = op(out[:-more], out[more:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def utf8(texts) -> list[bytes]:
    """Null is empty; a lone surrogate, which UTF-8 cannot hold, becomes '?'."""
    return [b"" if x is None else x if isinstance(x, bytes) else x.encode("utf-8", "replace") for x in texts]
