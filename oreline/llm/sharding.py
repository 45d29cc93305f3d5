"""Sharding by a k-d tree over metadata, native operations only.

Method.  The tree starts with all rows and the wanted number of shards.  A node
for k shards is cut in two, for k // 2 and the rest, at the weighted quantile
of its widest dimension that halves its bytes in that ratio; leaves hold the
target bytes.  Quantiles are found for all nodes of a level at once by
histograms of BINS sums each that narrow down around the cut, so a level costs
a few aggregations of one narrow table and the driver holds at most
shards * BINS sums.

Equal texts are one unit and stay together.  Only a group that weighs more than
a whole leaf, of which there are fewer than shards, cannot: it is dealt to
SALTS units by the hash of the id, so it can be cut anywhere.  Units heavier than
1 / HEAVY of a leaf, at most shards * HEAVY, are dealt before each cut, the
heaviest first, to the side with more room for each of its leaves; the cut is
then sought among the others for the bytes that are left to go.  A lighter unit
that it would go through is put on one side and the cut sought again.  So leaves
stay equal to about NEAR of a leaf, or two common units, however heavy single
groups are.

Defined cases.  Null text has no bytes.  Null metadata sorts first.  Ids that
are not whole numbers take part by their hash.  Repeated rows are rows of their
own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, kind_of

SHARDS, BINS, SALTS, HEAVY, NEAR = 24, 1024, 4096, 20, 0.0005
SLOT_ROWS = 4096
DIMENSIONS = ("source", "lang", "id", "bytes")
_TIES = 1 << 40


def _code(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(-1))


def _number(rows: DataFrame) -> Column:
    """The id as a whole number: itself, or 48 bits of its hash."""
    whole = kind_of(rows, "doc_id") in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.shiftrightunsigned(F.xxhash64("doc_id"), 16), F.lit(-1)).cast("long")


def _units(rows: DataFrame, steps: Steps, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with a salt, units, total bytes)."""
    group = rows.groupBy("hi", "lo").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min(_code("source")).alias("source"), F.min(_code("lang")).alias("lang"), F.min(_number(rows)).alias("id"), F.min("size").alias("bytes"))
    group = steps.write(group, "groups")
    total = group.agg(F.sum("w")).first()[0] or 0
    heavy = group.where((F.col("n") > 1) & (F.col("w") * shards > total))
    # fewer than shards rows
    key = F.broadcast(heavy.select("hi", "lo", F.lit(True).alias("heavy")))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    salted = rows.join(key, ["hi", "lo"], "left").withColumn("salt", salt)
    parts = salted.where("heavy").groupBy("hi", "lo", "salt").agg(F.sum("size").alias("w"))
    parts = parts.join(F.broadcast(heavy.drop("w", "n")), ["hi", "lo"])
    light = group.join(key, ["hi", "lo"], "left_anti").withColumn("salt", F.lit(-1))
    columns = ["hi", "lo", "salt", "w", *DIMENSIONS]
    units = light.select(columns).unionByName(parts.select(columns))
    return salted.drop("heavy"), steps.write(units.withColumn("tie", F.pmod(F.xxhash64("hi", "lo", "salt"), F.lit(_TIES))), "units"), total


class _Cut:
    """The search for one node's cut: on a dimension, then on the tie hash within one value of it.

    ``pins`` are units (value, tie) above ``heavy`` that go left whatever the cut, or
    right if they weigh more than is still to go left.
    """

    def __init__(self, node: int, dimension: str, low: int, high: int, goal: float, heavy: float):
        self.node, self.dimension, self.range, self.goal, self.heavy = node, dimension, (low, high), goal, heavy
        self.pins: tuple[list[tuple[int, int]], list[tuple[int, int]]] = [], []
        self.cut, self.done = None, False
        self.begin()

    def begin(self) -> None:
        (self.low, self.high), self.value, self.below = self.range, None, 0

    @property
    def column(self) -> Column:
        return F.col("tie") if self.value is not None else F.col(self.dimension)

    def pinned(self, side: int) -> Column:
        return functools.reduce(Column.__or__, [(F.col(self.dimension) == v) & (F.col("tie") == t) for v, t in self.pins[side]], F.lit(False))

    def within(self) -> Column:
        inside = self.column.between(self.low, self.high) & ~self.pinned(0) & ~self.pinned(1)
        return inside & (F.col(self.dimension) == self.value) if self.value is not None else inside

    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def narrow(self, bins: list, near: float) -> None:
        """bins: (least, greatest, weight) in order.  The cut comes to lie after ``below`` bytes, or next to the light bin that crosses the goal."""
        before = None
        for least, most, weight in bins:
            if self.below + weight < self.goal:
                self.below += weight
                before = most
                continue
            if weight > near and least < most:
                self.low, self.high = least, most
                return
            if weight > near and self.value is None:
                self.value, self.low, self.high = least, 0, _TIES - 1
                return
            if weight > self.heavy:
                fits = weight <= self.goal
                self.pins[0 if fits else 1].append((self.value, least))
                self.goal -= weight if fits else 0
                self.begin()
                return
            nearer = self.goal - self.below < weight / 2
            self.end(before if before is not None else least - 1, most, nearer)
            return
        self.end(before if before is not None else self.low - 1, before if before is not None else self.low - 1, False)

    def end(self, before, most, nearer: bool) -> None:
        self.cut, self.done = (before if nearer else most), True

    def left(self) -> Column:
        c = F.col(self.dimension)
        side = c <= self.cut if self.value is None else (c < self.value) | ((c == self.value) & (F.col("tie") <= self.cut))
        return (side & ~self.pinned(1)) | self.pinned(0)


def _deal(heavy: list, goal: float, total: float, k: int) -> tuple[list, list]:
    """The units (hi, lo, salt, weight) left and right of a cut for k leaves: each goes where there is more room for a leaf."""
    sides: tuple[list, list] = [], []
    room, leaves = [goal, total - goal], (k // 2, k - k // 2)
    for unit in heavy:
        i = 0 if room[0] / leaves[0] >= room[1] / leaves[1] else 1
        sides[i].append(unit)
        room[i] -= unit[3]
    return sides


def _tree(units: DataFrame, heavy: list, shards: int, total: int) -> tuple[Column, list[tuple]]:
    """The shard of a light unit, as an expression over its dimensions, and (hi, lo, salt, shard) of the heavy ones, which come heaviest first."""
    near = NEAR * total / shards
    left: dict[tuple[int, int], Column] = {}

    def place(first: int, k: int) -> Column:
        """The first shard of the node that a unit lies in, below the node for shards first .. first + k - 1."""
        if (first, k) not in left:
            return F.lit(first)
        return F.when(left[first, k], place(first, k // 2)).otherwise(place(first + k // 2, k - k // 2))

    open_nodes, own = ({0: shards} if shards > 1 else {}), {0: heavy}
    span = None
    while open_nodes:
        here = units.withColumn("node", place(0, shards)).where(F.col("node").isin(list(open_nodes)))
        stats = here.groupBy("node").agg(F.sum("w").alias("w"), F.count("*").alias("units"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]).collect()
        span = span or {d: max(1, stats[0][f"{d}_max"] - stats[0][f"{d}_min"]) for d in DIMENSIONS} if stats else {}
        stats = {s["node"]: s for s in stats}
        cuts, following = [], {}
        for node, k in open_nodes.items():
            s, mine = stats.get(node), own.pop(node, [])
            weight = (s["w"] if s else 0) + sum(u[3] for u in mine)
            goal = weight * (k // 2) / k
            own[node], own[node + k // 2] = _deal(mine, goal, weight, k)
            if s:
                wide = max(DIMENSIONS, key=lambda d: (s[f"{d}_max"] - s[f"{d}_min"]) / span[d])
                cuts.append(_Cut(node, wide, s[f"{wide}_min"], s[f"{wide}_max"], goal - sum(u[3] for u in own[node]), max(near, 4 * s["w"] / s["units"])))
            following |= {node: k // 2, node + k // 2: k - k // 2}
        while todo := [c for c in cuts if not c.done]:
            which, value, inside = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)
            for c in todo:
                mine = F.col("node") == c.node
                which = F.when(mine, F.floor((c.column - F.lit(c.low)) / F.lit(c.width())).cast("long")).otherwise(which)
                value = F.when(mine, c.column).otherwise(value)
                inside = F.when(mine, c.within()).otherwise(inside)
            sums = here.where(inside).select("node", which.alias("bin"), value.alias("v"), "w").groupBy("node", "bin").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("w").alias("w")).collect()
            for c in todo:
                c.narrow(sorted((r["a"], r["b"], r["w"]) for r in sums if r["node"] == c.node), near)
        left |= {(c.node, open_nodes[c.node]): c.left() for c in cuts}
        open_nodes = {n: k for n, k in following.items() if k > 1}
    return place(0, shards), [(*u[:3], shard) for shard, mine in own.items() for u in mine]


def kd_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    steps = Steps(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hi"), F.hash(text).alias("lo"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
    )
    rows = steps.write(rows, "rows")
    salted, units, total = _units(rows, steps, shards)
    weighty = F.col("w") * shards * HEAVY > total
    # at most shards * HEAVY rows
    heavy = [tuple(r) for r in units.where(weighty).select("hi", "lo", "salt", "w").orderBy(F.desc("w"), "hi", "lo", "salt").collect()]
    light = units.where(~weighty)
    shard, dealt = _tree(light, heavy, shards, total)
    dealt = spark.createDataFrame(dealt, "hi long, lo int, salt int, shard int")
    placed = steps.write(light.select("hi", "lo", "salt", shard.cast("int").alias("shard")).unionByName(dealt), "placed")
    buckets = max(1, math.ceil(rows.count() / shards / SLOT_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")
    placed = steps.write(salted.join(placed, ["hi", "lo", "salt"]).select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "rows")
    # slots: a number within a bucket of about SLOT_ROWS rows, after the rows of the shard's earlier buckets
    count = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    count = steps.write(count.select("shard", "bucket", before.alias("before")), "buckets")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("number", number).join(count, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
