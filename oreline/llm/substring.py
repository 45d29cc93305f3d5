"""Substring dedup: a log-structured index of window fingerprints.

Method.  A window is ``window`` consecutive words.  Each window is represented
by its least ``gram``-word fingerprint (winnowing), so equal windows always
share a fingerprint while about 2 of ``window - gram + 2`` are stored.  The
index is a folder of sorted immutable runs and a manifest, which a later
session can open again.  A new batch becomes a run and is merge-joined with
every older run.  A shared fingerprint only makes a window a candidate: it is
verified by hashes of all its words (64 and 32 bits of two independent
functions) before it counts as repeated.  A batch costs a pass over itself and,
of the older texts, those that hold a fingerprint which only this batch makes a
shared one.  Beyond ``max_runs``, runs are merged into one.

Defined cases.  Null text is empty.  Texts shorter than a window keep all
words.  Equal texts of a batch are one entry with a copy count; with two copies
or more every window repeats, so all words of a text of at least ``window``
words go.  Copies in different batches are entries of their own.  Repeated rows
are copies.  Other columns of the input are not read.  An empty batch is a run
without rows.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, binaries, exists, keyed
from .wordhash import hash_words, signed, sliding, window_hashes

WINDOW, GRAM, BATCHES, MAX_RUNS = 35, 10, 3, 2
_CHUNK = 2 << 20
_TEXTS, _RUN, _SHARED, _WINDOWS = "hi long, lo int, text string, copies long", "fp long, hi long, lo int, twice boolean", "fp long", "w1 long, w2 int, batch int, hi long, lo int, pos int"


def chunks(texts: list[bytes], limit: int = _CHUNK):
    """Index ranges of about ``limit`` bytes of text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def _least(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least fingerprint of each window, and which positions are least in some window (all of equal ones)."""
    low = sliding(grams, width)
    pad = np.zeros(width - 1, dtype=np.uint64)
    best = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return low, best == grams


def fingerprints(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(fp, hi, lo, twice): the winnowed fingerprints of each text of (hi, lo, text), and whether it holds one at two places."""
    width = window - gram + 1

    def run(batches):
        for batch in batches:
            text, hi, lo = binaries(batch.column("text")), batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
            for a, b in chunks(text):
                off, (words,) = hash_words(text[a:b])
                fps, who, twice = [], [], []
                for i in np.flatnonzero(np.diff(off) >= window):
                    grams = window_hashes(words[off[i] : off[i + 1]], gram)
                    fp, n = np.unique(grams[_least(grams, width)[1]], return_counts=True)
                    fps.append(fp)
                    twice.append(n > 1)
                    who.append(np.full(len(fp), a + i))
                if fps:
                    at = np.concatenate(who)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(fps))), pa.array(hi[at]), pa.array(lo[at]), pa.array(np.concatenate(twice))], ["fp", "hi", "lo", "twice"])

    return texts.select("hi", "lo", "text").mapInArrow(run, _RUN)


def _windows(found: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, batch, hi, lo, pos): two hashes of every window of (batch, hi, lo, text, fps) whose least fingerprint is among fps."""
    width = window - gram + 1

    def run(batches):
        for batch in batches:
            text, own, hi, lo = binaries(batch.column("text")), *(batch.column(c).to_numpy() for c in ("batch", "hi", "lo"))
            fps = batch.column("fps")
            for a, b in chunks(text, _CHUNK // 2):
                off, lanes = hash_words(text[a:b], 2)
                for i in range(b - a):
                    one = [x[off[i] : off[i + 1]] for x in lanes]
                    low = signed(_least(window_hashes(one[0], gram), width)[0])
                    at = np.flatnonzero(np.isin(low, fps[a + i].values.to_numpy()))
                    if len(at):
                        w1, w2 = signed(window_hashes(one[0], window)[at]), (window_hashes(one[1], window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *(pa.array(np.full(len(at), x[a + i])) for x in (own, hi, lo)), pa.array(at.astype(np.int32))], ["w1", "w2", "batch", "hi", "lo", "pos"])

    return found.select("batch", "hi", "lo", "text", "fps").mapInArrow(run, _WINDOWS)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(batch, hi, lo, copies, n_words, n_removed, kept_text) of (batch, hi, lo, text, copies, starts)."""

    def run(batches):
        for batch in batches:
            text, copies, starts = binaries(batch.column("text")), batch.column("copies").to_pylist(), batch.column("starts")
            n_words, n_removed, kept = [], [], []
            for t, c, s in zip(text, copies, starts, strict=True):
                words = t.split()
                n_words.append(len(words))
                if c > 1 and len(words) >= window:
                    kept.append(b"")
                    n_removed.append(len(words))
                elif s.is_valid and len(s):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = s.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    rest = [words[i] for i in np.flatnonzero(keep)]
                    kept.append(b" ".join(rest))
                    n_removed.append(len(words) - len(rest))
                else:
                    kept.append(b" ".join(words))
                    n_removed.append(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("batch", "hi", "lo", "copies")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["batch", "hi", "lo", "copies", "n_words", "n_removed", "kept_text"],
            )

    return texts.select("batch", "hi", "lo", "text", "copies", "starts").mapInArrow(run, "batch int, hi long, lo int, copies long, n_words long, n_removed long, kept_text string")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class FingerprintIndex:
    """Runs of fingerprints in a folder; each is bucketed and sorted by fp, so joins between runs move no data.
    Joins read a bucket as a stream, so a fingerprint that very many texts share costs its bucket time, not memory.

    The manifest holds a row per live table of each version: the last version
    counts.  A batch is in the index once its version is; only then do the files
    that it replaced go, and until then this object and the folder are as they
    were, wherever it fails.  ``path`` opens the index in that folder, or begins
    one there.
    """

    #: schema and bucket columns of the kinds of tables; narrow ones, which are cheap to move, are plain
    KINDS = {"texts": (_TEXTS, ("hi", "lo")), "run": (_RUN, ("fp",)), "shared": (_SHARED, ()), "windows": (_WINDOWS, ())}

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.steps = Steps(spark, "fingerprints", path)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.batches = 0, 0
        self.tables: dict[str, list[DataFrame]] = {k: [] for k in self.KINDS}
        if path and exists(spark, self._manifest):
            self._open()

    @property
    def _manifest(self) -> str:
        return f"{self.steps.base}/manifest"

    def _open(self) -> None:
        rows = self.spark.read.schema("version long, place int, kind string, path string, buckets int, batches int, window int, gram int").json(self._manifest)
        live = sorted(rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect(), key=lambda r: r["place"])
        for r in live:
            schema, columns = self.KINDS[r["kind"]]
            table = self.steps.open(r["path"], schema, (r["buckets"], *columns)) if columns else self.spark.read.schema(schema).parquet(r["path"])
            table._oreline_path = r["path"]
            self.tables[r["kind"]].append(table)
            self.version, self.batches, self.buckets, self.window, self.gram = r["version"], r["batches"], r["buckets"], r["window"], r["gram"]
        self.steps._n = time.time_ns() // 1_000_000  # no name that a failed batch of another session has used

    def _commit(self) -> None:
        """A new version: the live tables, a few rows."""
        self.version += 1
        live = [(kind, t._oreline_path) for kind, tables in self.tables.items() for t in tables]
        rows = [(self.version, i, kind, path, self.buckets, self.batches, self.window, self.gram) for i, (kind, path) in enumerate(live)]
        self.spark.createDataFrame(rows, "version long, place int, kind string, path string, buckets int, batches int, window int, gram int").coalesce(1).write.mode("append").json(self._manifest)

    def _add(self, kind: str, df: DataFrame, codec: str = "zstd", deal: bool = False) -> DataFrame:
        """Writes a table; ``deal`` moves rows to their buckets first, so that there is a file per bucket and not one per task and bucket."""
        columns = self.KINDS[kind][1]
        df = df.repartition(self.buckets, *columns) if deal and columns else df
        table = self.steps.write(df, kind, codec, (self.buckets, *columns) if columns else None)
        self.tables[kind].append(table)
        return table

    def _holders(self, run: DataFrame, fps: DataFrame) -> DataFrame:
        """(hi, lo, fps) of the texts of a run that hold some of ``fps``."""
        return run.join(fps, "fp", "left_semi").groupBy("hi", "lo").agg(F.collect_list("fp").alias("fps"))

    def ingest(self, rows: DataFrame) -> None:
        """Adds a batch of rows (hi, lo, text): its run, the fingerprints it makes shared, and the verified windows behind them."""
        before = self.version, self.batches, {kind: list(tables) for kind, tables in self.tables.items()}
        try:
            self._ingest(rows)
            gone = self._merge() if len(self.tables["run"]) > self.max_runs else []
            self._commit()
        except BaseException:
            self.version, self.batches, self.tables = before
            raise
        self.steps.drop(*gone)

    def _ingest(self, rows: DataFrame) -> None:
        self.batches += 1
        # one entry per text; the partial aggregate thins out copies before they are moved
        texts = self._add("texts", rows.groupBy("hi", "lo").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("hi", "lo", "text", "copies"))
        older = list(self.tables["run"])
        run = self._add("run", fingerprints(texts, self.window, self.gram), "lz4", True)
        keys = run.groupBy("fp").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
        for k, old in enumerate(older):
            keys = keys.join(old.groupBy("fp").agg(F.lit(True).alias(f"old{k}")), "fp", "left")
        in_old = reduce(Column.__or__, [F.coalesce(F.col(f"old{k}"), F.lit(False)) for k in range(len(older))], F.lit(False))
        hits = self.steps.write(keys.select("fp", (F.col("twice") | (F.col("n") > 1)).alias("inside"), in_old.alias("old")).where("inside or old"), "hits", "lz4")
        parts = [self._texts_of(self.batches, self._holders(run, hits.select("fp")))]
        if older:
            # what earlier batches made shared is verified already
            fresh = hits.where("old").select("fp")
            for known in self.tables["shared"]:
                fresh = fresh.join(known, "fp", "left_anti")
            fresh = self.steps.write(fresh, "fresh", "lz4")
            held = self.steps.write(_all([self._holders(old, fresh) for old in older]), "held", "zstd")
            parts += [self._texts_of(k, held) for k in range(1, self.batches)]
        self._add("windows", _windows(_all(parts), self.window, self.gram))
        self._add("shared", reduce(lambda x, known: x.join(known, "fp", "left_anti"), self.tables["shared"], hits.select("fp")), "lz4")

    def _texts_of(self, batch: int, held: DataFrame) -> DataFrame:
        return self.tables["texts"][batch - 1].join(held.hint("merge"), ["hi", "lo"]).select(F.lit(batch).alias("batch"), "hi", "lo", "text", "fps")

    def _merge(self) -> list[DataFrame]:
        """Merges all runs into one, and the shared fingerprints likewise; returns the tables that may go once this is a version."""
        gone = []
        for kind in ("run", "shared"):
            old, self.tables[kind] = self.tables[kind], []
            self._add(kind, _all(old), "lz4", True)
            gone += old
        return gone

    def starts(self) -> DataFrame:
        """(batch, hi, lo, starts): where windows begin that are found twice or more in all that was ingested."""
        windows = _all(self.tables["windows"])
        again = self.steps.write(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again", "lz4")
        return windows.join(again, ["w1", "w2"], "left_semi").groupBy("batch", "hi", "lo").agg(F.collect_list("pos").alias("starts"))

    def cut(self) -> DataFrame:
        """(batch, hi, lo, copies, n_words, n_removed, kept_text) of every text ingested."""
        starts = self.steps.write(self.starts(), "starts")
        parts = [t.join(starts.where(F.col("batch") == k).drop("batch").hint("merge"), ["hi", "lo"], "left").withColumn("batch", F.lit(k)) for k, t in enumerate(self.tables["texts"], 1)]
        return _cut(_all(parts), self.window)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Removes each word covered by a window that also starts anywhere else.

    Returns (rows, texts): ``rows`` is (doc_id, hi, lo) of every input row and
    ``texts`` is (hi, lo, copies, n_words, n_removed, kept_text) of every
    distinct text.  The texts enter an index (in the folder ``path``, if given)
    in ``batches`` batches.
    """
    rows = keyed(docs, id_col, text_col)
    index = FingerprintIndex(docs.sparkSession, path, window, gram)
    for k in range(batches):
        index.ingest(rows.where(F.pmod("lo", F.lit(batches)) == k).select("hi", "lo", "text"))
    return rows.select("doc_id", "hi", "lo"), index.cut().drop("batch")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    done = Steps(spark, "substring").write(texts.select("hi", "lo", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), "texts")
    return rows.join(done, ["hi", "lo"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
