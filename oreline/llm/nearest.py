"""Approximate nearest neighbours: collision-counting hashing.

Method.  Vectors are projected on PROJECTIONS lines, taken from random
rotations; each projection is a sorted array.  A query's window on every array
is centred on the query's own projection and grows by virtual rehashing:
half-width = WIDTH * radius, the radius times GROWTH each round.  A vector
found in enough of the windows is verified by its exact distance.  Once k are
verified, their k-th distance is the last radius.

Enough is the number of windows that RECALL of all vectors at exactly the
radius fall into, measured on simulated directions; nearer ones fall into more.

Vectors are dealt to blocks by a hash of their row.  A query first searches its
own block, which bounds its k-th distance; the other blocks are searched once,
with that radius.  The k best of all blocks are merged.  No task holds more
than a block and QUERY_BLOCK queries, and every vector is indexed.

Defined cases.  Vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id.  Vectors only meet vectors
of the same length.  Rows that share an id are vectors of their own, as
candidates and as queries; a query never finds its own row.  Ties go to the
smaller id.  Fewer than k candidates are all returned.  Other columns are not
read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps

K, PROJECTIONS, WIDTH, RECALL, GROWTH = 10, 256, 1.3, 0.97, 1.08
BLOCK, QUERY_BLOCK = 8192, 2048
_SEED, _SIMULATED, _SAMPLE = 11, 4096, 256


@functools.lru_cache(maxsize=8)
def lines_of(size: int, projections: int = PROJECTIONS) -> tuple[np.ndarray, int]:
    """Directions of length sqrt(size), as columns, and the collisions that are enough."""
    rng = np.random.default_rng(_SEED + size)
    turns = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(math.ceil(projections / size))]
    lines = np.hstack(turns)[:, :projections] * math.sqrt(size)
    away = rng.normal(size=(_SIMULATED, size))
    away /= np.linalg.norm(away, axis=1)[:, None]
    hits = (np.abs(away @ lines) <= WIDTH).sum(1)
    return lines, max(1, int(np.quantile(hits, 1 - RECALL, method="lower")))


def _place(arrays: np.ndarray, values: np.ndarray, right: bool) -> np.ndarray:
    """np.searchsorted of a value in each row of sorted arrays, all rows at once."""
    low, high = np.zeros(len(arrays), dtype=np.int64), np.full(len(arrays), arrays.shape[1])
    row = np.arange(len(arrays))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, arrays.shape[1] - 1)
        x = arrays[row, middle]
        up = (low < high) & ((x <= values) if right else (x < values))
        low, high = np.where(up, middle + 1, low), np.where(up | (low >= high), high, middle)
    return low


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.lines, self.enough = lines_of(vectors.shape[1])
        p = (vectors @ self.lines).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        some = vectors[np.linspace(0, len(vectors) - 1, min(len(vectors), _SAMPLE)).astype(np.int64)]
        apart = np.sqrt(np.maximum(((some[:, None, :] - some[None, :, :]) ** 2).sum(2), 0))
        self.apart = np.sort(apart[np.triu_indices(len(some), 1)])
        self.apart = self.apart[self.apart > 0]

    def first_radius(self, k: int) -> float:
        """About the radius within which k vectors lie."""
        if not len(self.apart):
            return math.inf
        return float(self.apart[min(len(self.apart) - 1, int(len(self.apart) * k / len(self.vectors)))]) * 0.8

    def search(self, q: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and distances of the k nearest found within ``bound``, by (distance, id), without the row ``own``; and how many were verified."""
        n = len(self.vectors)
        at = q @ self.lines
        low = _place(self.sorted, at, False)
        high = low.copy()
        counts = np.zeros(n, dtype=np.int64)
        done = self.rows == own
        found, dist, verified = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        radius = bound if bound < math.inf else self.first_radius(k)
        while True:
            a, b = (_place(self.sorted, at - WIDTH * radius, False), _place(self.sorted, at + WIDTH * radius, True)) if radius < math.inf else (np.zeros_like(low), np.full_like(high, n))
            a, b = np.minimum(a, low), np.maximum(b, high)
            new = [x for o, i, j, h, e in zip(self.order, a.tolist(), low.tolist(), high.tolist(), b.tolist(), strict=True) for x in (o[i:j], o[h:e])]
            low, high = a, b
            counts += np.bincount(np.concatenate(new), minlength=n)
            more = np.flatnonzero((counts >= self.enough) & ~done)
            if len(more):
                done[more] = True
                verified += len(more)
                found = np.concatenate([found, more])
                dist = np.concatenate([dist, np.sqrt(((self.vectors[more] - q) ** 2).sum(axis=1))])
                best = np.lexsort((self.ids[found], dist))[:k]
                found, dist = found[best], dist[best]
            last = min(bound, dist[-1] if len(found) >= k else math.inf)
            if radius >= last or done.all():
                near = dist <= bound
                return found[near], dist[near], verified
            radius = min(radius * GROWTH, last) if radius > 0 else last


def _usable(df: DataFrame, id_col: str, vec_col: str, asks: Column) -> DataFrame:
    """(id, vec, asks) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")).where("id is not null and size(vec) > 0")
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False)))


_FOUND = "query_row long, query_id long, vec_id long, score double, verified long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def nearest(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest vectors found for each row where ``asks`` holds; verified counts the exact distances of the query."""
    steps = Steps(vectors.sparkSession, "nearest")
    data = steps.write(_usable(vectors, id_col, vec_col, asks).withColumn("row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, math.ceil(data.count() / BLOCK))
    groups = max(1, math.ceil(data.where("asks").count() / QUERY_BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    data = data.withColumns({"dim": F.size("vec"), "block": deal(blocks, 0)})

    def answer(own: pd.DataFrame, ask: pd.DataFrame, bounded: bool) -> pd.DataFrame:
        """A row per neighbour found; a query without any has one of nulls, which carries its verified count."""
        if own.empty or ask.empty:
            return pd.DataFrame({c: [] for c in _NAMES}).astype({"query_row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})
        index = CollisionIndex(np.stack(own["vec"].to_numpy()), own["id"].to_numpy(), own["row"].to_numpy())
        parts: list[list] = [[] for _ in _NAMES]
        for row, name, v, bound in zip(ask["row"], ask["id"], ask["vec"], ask["bound"] if bounded else [math.inf] * len(ask), strict=True):
            at, dist, verified = index.search(np.asarray(v), row, k, bound)
            n = max(1, len(at))
            for part, x in zip(parts, ([row] * n, [name] * n, index.ids[at].tolist() or [None], dist.tolist() or [None], [verified] + [0] * (n - 1)), strict=True):
                part += x
        return pd.DataFrame(dict(zip(_NAMES, parts, strict=True))).astype({"vec_id": "Int64", "score": "float64"})

    # a fixed count: few bytes are much work here, so partitions are not to be put together by size
    home = data.repartition(blocks, "dim", "block").groupBy("dim", "block").applyInPandas(lambda pdf: answer(pdf, pdf[pdf["asks"]], False), _FOUND)
    home = steps.write(home, "home")
    found = home
    if blocks > 1:
        reach = home.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("score") >= k, F.max("score")).otherwise(F.lit(math.inf)).alias("bound"))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        ask = data.where("asks").join(reach, "row").withColumn("group", deal(groups, 1)).withColumn("other", every(blocks)).where("other <> block")
        ask = ask.select("bound", *[F.col(c).alias(f"q_{c}") for c in ("row", "id", "vec", "dim", "other", "group")])
        own = data.select("row", "id", "vec", "dim", "block", every(groups).alias("group"))
        left, right = ["dim", "block", "group"], ["q_dim", "q_other", "q_group"]
        n = blocks * groups
        search = lambda a, b: answer(a, b.rename(columns=lambda c: c.removeprefix("q_")), True)
        other = own.repartition(n, *left).groupBy(*left).cogroup(ask.repartition(n, *right).groupBy(*right)).applyInPandas(search, _FOUND)
        found = steps.write(home.unionByName(other), "found")
    per = Window.partitionBy("query_row")
    marks = {"rank": F.row_number().over(per.orderBy(F.col("score").asc_nulls_last(), "vec_id")).cast("int"), "verified": F.sum("verified").over(per)}
    ranked = found.withColumns(marks).where((F.col("rank") <= k) & F.col("score").isNotNull())
    return ranked.select("query_id", "rank", "vec_id", "score", "verified")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
