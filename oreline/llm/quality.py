"""Quality rules: divergence of a text from language references.

Method.  A text's histogram over character classes, and its histogram over the
common words of a language (all other words together), are compared with a
reference by the Jensen-Shannon distance (base 2, 0 to 1).  References are
counted over the corpus by the language column, of each distinct text once and
only of texts that pass the base rules, so neither copies nor junk shape them.
A value of the column is a reference only if it has LEAST_TEXTS such texts of
MIN_CHARS characters and MIN_WORDS words or more, LEAST_CHARS characters in all
and a share of LEAST_SHARE of all characters, so there are at most
1 / LEAST_SHARE references.  A text is compared with the reference of its own
language; one whose language is no reference with each, and the nearest counts.
It is kept if it is near enough on both histograms.  Short texts have unreliable
histograms: below MIN_CHARS the character test, and below MIN_WORDS the word
test, says nothing and passes.

Base rules: see ``base_metrics``.

Defined cases.  Null text is empty: all metrics 0, base_failed.  A null or
blank language is never a reference.  A corpus where no language has texts
enough has no reference, and then only the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, binaries
from .substring import chunks
from .wordhash import PUNCTUATION, hash_words, window_hashes

WORD_BITS, COMMON = 13, 60
MIN_CHARS, MIN_WORDS = 200, 50
LEAST_TEXTS, LEAST_CHARS, LEAST_SHARE = 20, 20_000, 0.001
#: About the 99.9th and the 99th percentile of the rows labelled good that pass the base rules at sf0.1 (0.227 and 0.376).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.23, 0.38
#: Character classes: 0 continuation byte, 1 white space, 2 lower case, 3 upper case, 4 digit, 5 sentence punctuation, 6 symbol, 7 other ASCII, 8 beyond ASCII.
CLASSES = 9
_CLASS = np.full(256, 7, dtype=np.uint8)
for _c in range(256):
    if _c >= 0x80:
        _CLASS[_c] = 0 if _c < 0xC0 else 8
    elif _c in b" \t\n\v\f\r":
        _CLASS[_c] = 1
    elif chr(_c).islower():
        _CLASS[_c] = 2
    elif chr(_c).isupper():
        _CLASS[_c] = 3
    elif chr(_c).isdigit():
        _CLASS[_c] = 4
    elif _c in b".,;:!?'\"()-":
        _CLASS[_c] = 5
    elif _c in b"#*$%&|<>":
        _CLASS[_c] = 6


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=CLASSES)


def base_metrics(text: bytes, words: np.ndarray, classes: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text, its word hashes and its class counts."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    three = window_hashes(words, 3)
    repeated = 0
    if len(three):
        _, at, n = np.unique(three, return_inverse=True, return_counts=True)
        if len(n) < len(three):
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            start = np.flatnonzero(n[at] > 1)
            edge[start] += 1
            edge[start + 3] -= 1
            repeated = int(np.count_nonzero(np.cumsum(edge[:-1])))
    return len(words), int(classes[2:].sum()), int(classes[6]), len(lines) - len(set(lines)), repeated


def base_failed(metrics: tuple[int, int, int, int, int]) -> bool:
    return metrics[0] < 50 or 100 * metrics[4] > 50 * metrics[0]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashed buckets of the lower-cased words, free of punctuation."""
    off, (h,) = hash_words([t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts], 1, PUNCTUATION)
    return off, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def references(docs: DataFrame, steps: Steps, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language with texts enough: class shares, the COMMON most frequent word buckets, and their shares with that of all other words last.

    Counted over each distinct text that names a language and passes the base
    rules; a partition sends a row per language and bucket, the driver gets at
    most COMMON + CLASSES + 1 rows per reference.
    """
    n_words, n_texts = 1 << WORD_BITS, (1 << WORD_BITS) + CLASSES

    def rows_of(total: dict[str, np.ndarray]):
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "at", "n"])
        total.clear()

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            text, lang = binaries(batch.column("text")), np.array(batch.column("lang").to_pylist(), dtype=object)
            for a, b in chunks(text):
                off, word = _words(text[a:b])
                raw, (own,) = hash_words(text[a:b])
                classes = np.array([class_counts(t) for t in text[a:b]])
                clean = np.array([not base_failed(base_metrics(t, own[raw[i] : raw[i + 1]], classes[i])) for i, t in enumerate(text[a:b])])
                n = np.diff(off)
                long_enough = clean & (n >= MIN_WORDS) & (classes[:, 1:].sum(1) >= MIN_CHARS)
                for name in set(lang[a:b]):
                    mine = clean & (lang[a:b] == name)
                    sums = total.setdefault(name, np.zeros(n_texts + 1, dtype=np.int64))
                    sums[:n_words] += np.bincount(word[np.repeat(mine, n)], minlength=n_words)
                    sums[n_words:n_texts] += classes[mine].sum(0)
                    sums[n_texts] += (mine & long_enough).sum()
                    if len(total) > 256:
                        yield from rows_of(total)
        yield from rows_of(total)

    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.select(F.xxhash64(text).alias("hi"), F.hash(text).alias("lo"), text.alias("text"), lang.alias("lang")).where((F.trim("lang") != "") & (F.length("text") > 0))
    # one row per text; the partial aggregate thins out copies before they are moved
    rows = rows.groupBy("hi", "lo").agg(F.first("text").alias("text"), F.min("lang").alias("lang")).select("text", "lang")
    sums = steps.write(rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")), "counts")
    sized = sums.groupBy("lang").agg(*[F.sum(F.when(c, F.col("n"))).alias(k) for k, c in {"words": F.col("at") < n_words, "chars": F.col("at").between(n_words + 1, n_texts - 1), "texts": F.col("at") == n_texts}.items()])
    least = max(LEAST_CHARS, LEAST_SHARE * (sized.agg(F.sum("chars")).first()[0] or 0))
    known = sized.where((F.col("texts") >= LEAST_TEXTS) & (F.col("chars") >= least)).select("lang", "words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy((F.col("at") >= n_words).desc(), F.desc("n"), "at"))
    # the classes and the number of texts come first, at most CLASSES + 1 rows; a language has a row per bucket at most
    top = sums.join(known, "lang").withColumn("place", place - F.sum((F.col("at") >= n_words).cast("int")).over(Window.partitionBy("lang"))).where(F.col("place") <= COMMON)
    out = {}
    for name, part in top.toPandas().sort_values(["lang", "place"]).groupby("lang"):
        classes = np.zeros(CLASSES)
        kind = part[(part["at"] >= n_words) & (part["at"] < n_texts)]
        classes[kind["at"] - n_words] = kind["n"]
        common, total = part[part["at"] < n_words], part["words"].iloc[0]
        share = np.append(common["n"], total - common["n"].sum()) / total
        out[name] = (classes[1:] / classes[1:].sum(), common["at"].to_numpy(dtype=np.int64), share)
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance of two distributions: the root of their divergence in bits."""
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, METRICS, base_failed, kept, nearest, char_distance, word_distance) of every row."""
    known = references(docs, Steps(docs.sparkSession, "quality"), text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text, lang = binaries(batch.column("text")), batch.column("lang").to_pylist()
            out: list[list] = [[] for _ in range(10)]
            for a, b in chunks(text):
                off, (words,) = hash_words(text[a:b])
                low, bucket = _words(text[a:b])
                for i in range(b - a):
                    classes = class_counts(text[a + i])
                    row = base_metrics(text[a + i], words[off[i] : off[i + 1]], classes)
                    failed = base_failed(row)
                    best = (2.0, 2.0, None)
                    mine, n_chars = bucket[low[i] : low[i + 1]], classes[1:].sum()
                    hist = np.bincount(mine, minlength=1 << WORD_BITS) if len(mine) >= MIN_WORDS else None
                    for name in [lang[a + i]] if lang[a + i] in known else known:
                        ref, common, share = known[name]
                        char = jensen_shannon(classes[1:] / n_chars, ref) if n_chars >= MIN_CHARS else 0.0
                        word = jensen_shannon(np.append(hist[common], len(mine) - hist[common].sum()) / len(mine), share) if hist is not None else 0.0
                        at = max(char / MAX_CHAR_DISTANCE, word / MAX_WORD_DISTANCE)
                        if best[2] is None or at < max(best[0] / MAX_CHAR_DISTANCE, best[1] / MAX_WORD_DISTANCE):
                            best = (char, word, name)
                    near = best[2] is None or (best[0] <= MAX_CHAR_DISTANCE and best[1] <= MAX_WORD_DISTANCE)
                    for column, value in zip(out, (*row, failed, near and not failed, best[2], *(None if best[2] is None else x for x in best[:2])), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", *METRICS, "base_failed", "kept", "nearest", "char_distance", "word_distance"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in METRICS) + ", base_failed boolean, kept boolean, nearest string, char_distance double, word_distance double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
