"""Toxicity: a factorisation machine over hashed terms.

Method.  Terms are lower-cased words and their 4- and 6-byte beginnings,
hashed to 2**20 buckets; a text has a term or not.  The score is

    sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))

over the terms i of the text, so a pair of terms such as an insult and the
mention of a group adds its own weight <v_i, v_j>.  The model is fitted on at
most SAMPLE labelled rows (those with the least hash of the id), on the TERMS
buckets with the largest chi-square of all that occur in MIN_ROWS rows or
more.  Only these two bounded tables reach the driver.

Defined cases.  Null text is empty; an empty text scores sigmoid(b).  Labels
without a value are not learnt from; equal rows are learnt from once; an id with several labels counts as toxic
if one of them is.  Without any labelled row of both kinds every score is the
share of toxic labels (0 if there are none).  Very long texts are hashed in
pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, binaries, text_of
from .substring import chunks
from .wordhash import PUNCTUATION, hash_words, utf8

BITS, PREFIXES = 20, (4, 6)
SAMPLE, TERMS, MIN_ROWS, FACTORS = 12_000, 1024, 5, 8
THRESHOLD = 0.3
HELD_OUT = 2


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every occurrence of a term bucket."""
    lowered = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]
    off, lanes = hash_words(lowered, 1, PUNCTUATION, PREFIXES)
    who = np.repeat(np.arange(len(texts)), np.diff(off))
    return np.tile(who, len(lanes)), (np.concatenate(lanes) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class FactorizationMachine:
    """Weights of the selected terms; ``slot`` maps a bucket to its row, or to -1."""

    bias: float
    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in chunks(texts, 1 << 20):
            who, term = terms_of(texts[a:b])
            at = self.slot[term]
            hit = at >= 0
            pair = np.unique(who[hit] * np.int64(len(self.w)) + at[hit])
            who, at = pair // max(len(self.w), 1), pair % max(len(self.w), 1)
            n = b - a
            z = self.bias + np.bincount(who, self.w[at], n)
            for f in range(self.v.shape[1]):
                x = self.v[at, f]
                z += 0.5 * (np.bincount(who, x, n) ** 2 - np.bincount(who, x * x, n))
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 40, rate: float = 0.03, decay: float = 2e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss of a dense 0/1 matrix; positives and negatives keep their natural weight."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, factors))]
    m, s, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 512):
            part, goal = x[order[a : a + 512]].astype(np.float64), y[order[a : a + 512]]
            b, w, v = theta
            sums = part @ v
            z = b[0] + part @ w + 0.5 * (sums**2 - part @ (v * v)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) / len(goal)
            grads = [np.array([g.sum()]), part.T @ g + decay * w, part.T @ (g[:, None] * sums) - v * (part.T @ g)[:, None] + decay * v]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                s[i] = 0.999 * s[i] + 0.001 * d * d
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """Fits on at most ``sample`` labelled rows whose id is not held out."""
    steps = Steps(docs.sparkSession, "toxicity")
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null")
    lab = lab.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lab = steps.write(lab, "labels")
    # at most ``sample`` rows of two numbers; several texts under one id can make more, so the bound is put on them again
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(lab), "doc_id")
    # equal rows say the same, so one of each is enough
    rows = steps.write(rows.withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"]), "texts")
    keys = rows.select("doc_id", "key").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(sample)
    rows = steps.write(rows.join(F.broadcast(keys), ["doc_id", "key"], "left_semi").select("y", "text"), "rows")

    def count(batches):
        n, pos, neg = np.zeros(2, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            text, y = binaries(batch.column("text")), batch.column("y").to_numpy() > 0
            for a, b in chunks(text, 1 << 20):
                who, term = terms_of(text[a:b])
                pair = np.unique(who << BITS | term)
                who, term = pair >> BITS, pair & ((1 << BITS) - 1)
                pos += np.bincount(term[y[a:b][who]], minlength=1 << BITS).astype(np.int32)
                neg += np.bincount(term[~y[a:b][who]], minlength=1 << BITS).astype(np.int32)
                n += [y[a:b].sum(), (~y[a:b]).sum()]
        at = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at]), pa.array([n[0], *pos[at]]), pa.array([n[1], *neg[at]])], ["term", "pos", "neg"])

    sums = rows.mapInArrow(count, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = steps.write(sums.where((F.col("term") < 0) | (F.col("p") + F.col("n") >= MIN_ROWS)), "terms")
    total = sums.where("term = -1").first()
    p, n = (total["p"], total["n"]) if total else (0, 0)
    slot = np.full(1 << BITS, -1, dtype=np.int16)
    if not p or not n:
        share = p / (p + n) if p + n else 0.0
        return FactorizationMachine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), slot, np.zeros(1), np.zeros((1, 0)))
    a, b, c, d = F.col("p"), F.col("n"), p - F.col("p"), n - F.col("n")
    # a bucket in every row says nothing: no chi
    chi = F.try_divide((p + n) * (a * d - b * c) * (a * d - b * c).cast("double"), F.lit(float(p)) * n * (a + b) * (c + d))
    best = sums.where("term >= 0").withColumn("chi", chi.cast("double")).where("chi > 12").orderBy(F.desc("chi"), "term").limit(TERMS).select("term").toPandas()["term"].to_numpy()
    slot[best] = np.arange(len(best))

    def matrix(batches):
        for batch in batches:
            text = binaries(batch.column("text"))
            x = np.zeros((len(text), len(best)), dtype=bool)
            for i, j in chunks(text, 1 << 20):
                who, term = terms_of(text[i:j])
                at = slot[term]
                x[who[at >= 0] + i, at[at >= 0]] = True
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["y", "x"])

    # at most sample rows of TERMS bits
    got = rows.mapInArrow(matrix, "y int, x binary").toPandas().sort_values(["y", "x"], kind="stable")
    x = np.unpackbits(np.frombuffer(b"".join(got["x"]), dtype=np.uint8).reshape(len(got), -1), axis=1)[:, : len(best)] if len(best) else np.zeros((len(got), 1))
    bias, w, v = fit(x, (got["y"] > 0).to_numpy(dtype=np.float64))
    return FactorizationMachine(bias, slot, w, v)


def score_column(model: FactorizationMachine, text_col: str = "text"):
    """The score of a text as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(utf8(texts)))

    return score(text_of(text_col))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
