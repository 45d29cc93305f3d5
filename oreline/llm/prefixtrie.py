"""Prefix trie of conversations by an external mergesort that carries common prefixes.

Method.  A turn is named by a digest of role and text and its length, 20 bytes;
a conversation's key is the string of its turns' names, so texts don't move and
keys of which one begins the other sort next to each other.  Equal
conversations become one entry.  Each task sorts its entries into a run and
stores with every entry the number of turns it shares with the one before it
(LCP).  Runs are dealt by ranges of keys, sampled by Spark, and a range's pieces
of all runs are merged by a loser tree: of two heads the one that shares more
turns with the last entry out is the smaller, so keys are compared only where
that ties, and only from there on.  The merged stream comes with LCPs; a stack
of open nodes follows it, and a node that the next entry doesn't share is
finished.

Spark's exchange and sort do the external part: the runs and the ranges.  A
range holds about RANGE_BYTES of keys, however common a first turn or a whole
conversation is.  Nodes on the path between two neighbouring ranges are known in
parts: they are emitted as such and summed by their keys, and up their path, as
tables.  Members that end at a node are joined into text per hundred ids before
they meet, and hashed as a stream in order.  A conversation is an array of names
in one row, 20 bytes a turn; that is the only thing gathered per id.

Defined cases.  Turns come in the order of turn, null first; of equal ones by
role, then by the digest of the text.  Null role or text is empty.  Rows without
an id take no part.  Ids are taken as longs, and c - c % 100 as SQL does, so
that -5 belongs to 0.  Repeated rows are turns of their own.  Only conv_id,
turn, role and text are read; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps
from .repair import CRC_TABLE, crc_sql

NAME = 20  # bytes that name a turn: 16 of a digest, 4 of its length in code points
RANGE_BYTES = 16 << 20
EMIT_ROWS = 20_000

_RUN = "run int, ord long, lcp int, key binary, conv long, n long, ends string"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Nodes; of those on a border between ranges also the number in their range, length of the last text and key's digest; of their finished children the parent's number.
_MERGED = _NODE + ", part int, border int, parent_border int, length long, path binary"
NOBODY = hashlib.sha256(b"").hexdigest()


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two keys share, of which ``known`` are known."""
    at, most = known * NAME, min(len(a), len(b))
    # whole stretches at once, then the turn in which they part
    step = NAME * 64
    while at + step <= most and a[at : at + step] == b[at : at + step]:
        at += step
    while at + NAME <= most and a[at : at + NAME] == b[at : at + NAME]:
        at += NAME
    return at // NAME


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(hundred, conv_id, key) of every conversation: the first h turns of c - c % 100, then its own after its first h."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    # the length of the role keeps (role, text) apart
    name = F.concat(F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role"), F.concat("role", "text")), 256)), 1, NAME - 4), F.unhex(F.lpad(F.hex(F.length("text")), 8, "0")))
    turns = given.select((F.col("conv_id") - F.col("conv_id") % 100).alias("hundred"), "conv_id", F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", name.alias("name")).alias("t"))
    # dealt by hundred, which the sequences, their first one and the classes below share
    own = turns.repartition("hundred").groupBy("hundred", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("hundred", "conv_id", F.col("ts.name").alias("names"))
    shared = F.first(F.when(F.col("conv_id") == F.col("hundred"), F.slice("names", 1, 5)), ignorenulls=True).over(Window.partitionBy("hundred"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    nothing = F.array().cast("array<binary>")
    names = F.concat(F.coalesce(F.slice("shared", 1, h), nothing), F.slice("names", h + 1, F.size("names")))
    return own.withColumn("shared", shared).select("hundred", "conv_id", F.unhex(F.array_join(F.transform(names, F.hex), "")).alias("key"))


def _sorted_runs(sequences: DataFrame) -> DataFrame:
    """A run a task: distinct keys in order, with what each shares with the one before, its least id, how many ids, and the digest of all."""
    ids = F.sort_array(F.collect_list("conv_id"))
    few = sequences.groupBy("hundred", "key").agg(ids.alias("ids")).select("key", "hundred", F.col("ids")[0].alias("conv"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches):
        number, order, last = TaskContext.get().partitionId(), 0, b""
        key = digest = None
        conv = n = 0
        rows: list[tuple] = []

        def close():
            nonlocal order, last
            rows.append((number, order, common_turns(last, key), key, conv, n, digest.hexdigest()))
            order, last = order + 1, key

        for batch in batches:
            for k, c, m, text in zip(*(batch.column(x).to_pylist() for x in ("key", "conv", "n", "text")), strict=True):
                if k != key:
                    if key is not None:
                        close()
                    key, digest, conv, n = k, hashlib.sha256(text.encode()), c, m
                else:
                    digest.update(b"," + text.encode())
                    conv, n = min(conv, c), n + m
            if rows:
                yield _batch(rows, _RUN)
                rows.clear()
        if key is not None:
            close()
            yield _batch(rows, _RUN)

    return few.repartition("key").sortWithinPartitions("key", "hundred").select("key", "conv", "n", "text").mapInArrow(run, _RUN)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def merged_runs(runs: list[list[tuple]]):
    """(lcp, key, ...) of all runs' entries (lcp, key, ...) in order of the key, by a loser tree; lcp is what an entry shares with the one before it."""
    k = len(runs)
    at, lcp = [0] * k, [0] * k  # the first of a run's piece has nothing before it
    heads = [r[0][1] for r in runs]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser then knows what it shares with it."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        c = common_turns(heads[a], heads[b], lcp[a])
        first = heads[a][c * NAME : (c + 1) * NAME] < heads[b][c * NAME : (c + 1) * NAME]
        lcp[b if first else a] = c
        return first

    # leaves are k .. 2k - 1, a node keeps the loser of its match
    winner, loser = [*[0] * k, *range(k)], [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1]
    while heads[best] is not None:
        yield (lcp[best], *runs[best][at[best]][1:])
        at[best] += 1
        more = at[best] < len(runs[best])
        heads[best], lcp[best] = (runs[best][at[best]][1], runs[best][at[best]][0]) if more else (None, 0)
        node = (best + k) // 2
        while node:
            if beats(loser[node], best):
                best, loser[node] = loser[node], best
            node //= 2


class _Open:
    """A node on the path of the last entry."""

    __slots__ = ("children", "conv", "depth", "ends", "first", "leaves", "length", "n", "rows", "saved")

    def __init__(self, depth: int, length: int, first: bool):
        self.depth, self.length, self.first = depth, length, first
        self.conv, self.ends, self.n, self.children, self.leaves, self.saved = None, None, 0, 0, 0, 0
        self.rows: list[list] = []  # finished children, which wait for the least id


def _paths(key: bytes, depth: int) -> list[bytes]:
    """Digests of a key's first 0 .. depth turns."""
    digest, out = hashlib.sha256(), []
    for d in range(depth + 1):
        digest.update(key[(d - 1) * NAME : d * NAME] if d else b"")
        out.append(digest.digest()[:16])
    return out


def trie_nodes(entries, part: int = 0, before: int = -1, after: int = -1):
    """Rows of _MERGED for the ordered entries (lcp, key, conv, n, ends) of a range, which shares ``before`` and ``after`` turns with its neighbours (-1: has none)."""
    stack, n_border, key = [_Open(0, 0, True)], 0, b""
    heads: list[bytes] = []
    tails: list[bytes] = []

    def close(ended: bool):
        nonlocal n_border
        node = stack.pop()
        parent = stack[-1] if stack else None
        border = (node.first and node.depth <= before) or (ended and node.depth <= after)
        leaves, saved = node.leaves, node.saved
        if border:
            n_border += 1
            yield (node.conv, node.depth, None, node.n, node.children, leaves, saved, node.ends, part, n_border, None, node.length, tails[node.depth] if ended and node.depth <= after else heads[node.depth])
        else:
            leaves, saved = leaves or 1, saved + (node.n - 1) * node.length
            own = [node.conv, node.depth, None, node.n, node.children, leaves, saved, node.ends or NOBODY, part, None, None, None, None]
            if parent:
                parent.children += 1
                parent.rows.append(own)
            else:
                yield tuple(own)
        for row in node.rows:
            row[2], row[10] = (None, n_border) if border else (node.conv, None)
            yield tuple(row)
        if parent:
            parent.n, parent.leaves, parent.saved = parent.n + node.n, parent.leaves + leaves, parent.saved + saved
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)

    opening = True
    for lcp, key, conv, n, ends in entries:  # noqa: B007 - the last key is used below
        if opening:
            heads = _paths(key, before)
        while stack[-1].depth > lcp:
            yield from close(False)
        for d in range(lcp + 1, len(key) // NAME + 1):
            stack.append(_Open(d, int.from_bytes(key[d * NAME - 4 : d * NAME], "big"), opening))
        top, opening = stack[-1], False
        top.n, top.ends, top.conv = top.n + n, ends, conv if top.conv is None else min(top.conv, conv)
    tails = _paths(key, after)
    while stack:
        yield from close(True)


def _neighbours(ranges: DataFrame) -> DataFrame:
    """(part, before, after): the turns that each range shares with its neighbours, or -1.  A row a range."""

    def run(batches):
        held = None
        rows: list[tuple] = []
        for batch in batches:
            for part, low, high in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high")), strict=True):
                shared = common_turns(held[2], low) if held else -1
                if held:
                    rows.append((*held[:2], shared))
                held = (part, shared, high)
        if held:
            rows.append((*held[:2], -1))
            yield _batch(rows, "part int, before int, after int")

    ends = ranges.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return ends.repartition(1).sortWithinPartitions("part").mapInArrow(run, "part int, before int, after int")


def _joined_borders(borders: DataFrame) -> DataFrame:
    """Whole nodes (path, ...) of the parts on borders.

    There is a path of nodes between two neighbouring ranges, so they are few: ranges times shared turns.
    By first range and depth they are in the order of the trie, and a stack of them gives parents and sums.
    """
    whole = borders.groupBy("path", "depth").agg(
        F.min("part").alias("part"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends"), F.first("length").alias("length"),
    )
    schema = _NODE + ", path binary"

    def run(batches):
        stack: list[dict] = []
        rows: list[tuple] = []

        def close():
            x = stack.pop()
            leaves, saved = x["n_leaves"] + (x["n_children"] == 0), x["saved_tokens"] + (x["n_convs"] - 1) * x["length"]
            if stack:
                stack[-1]["n_leaves"] += leaves - x["counted"][0]
                stack[-1]["saved_tokens"] += saved - x["counted"][1]
                stack[-1]["n_children"] += 1
            rows.append((x["conv_id"], x["depth"], stack[-1]["conv_id"] if stack else None, x["n_convs"], x["n_children"], leaves, saved, x["ends"] or NOBODY, x["path"]))

        for batch in batches:
            for x in batch.to_pylist():
                while stack and stack[-1]["depth"] >= x["depth"]:
                    close()
                # the ranges have these in the sums of the nodes above already
                stack.append(x | {"counted": (x["n_leaves"], x["saved_tokens"])})
            if len(rows) >= EMIT_ROWS:
                yield _batch(rows, schema)
                rows.clear()
        while stack:
            close()
        if rows:
            yield _batch(rows, schema)

    return whole.repartition(1).sortWithinPartitions("part", "depth").mapInArrow(run, schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    steps = Steps(spark, "trie")
    runs = steps.write(_sorted_runs(rebuilt(conversations)), "runs")
    size = runs.agg(F.sum(F.length("key") + 100)).first()[0] or 0
    n_ranges = max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    dealt = runs.repartitionByRange(n_ranges, "key").sortWithinPartitions("run", "ord").withColumn("part", F.spark_partition_id())
    ranges = steps.write(dealt, "ranges", spread=True)
    steps.drop(runs)
    known = ranges.join(F.broadcast(_neighbours(ranges)), "part")  # three numbers a range

    def run(batches):
        rows: list[tuple] = []
        held, pieces = None, {}

        def merge():
            yield from trie_nodes(merged_runs(list(pieces.values())), *held)

        for batch in batches:
            for part, before, after, number, *entry in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "after", "run", "lcp", "key", "conv", "n", "ends")), strict=True):
                if held is None or held[0] != part:
                    for row in merge() if held else ():
                        rows.append(row)
                        if len(rows) >= EMIT_ROWS:
                            yield _batch(rows, _MERGED)
                            rows.clear()
                    held, pieces = (part, before, after), {}
                pieces.setdefault(number, []).append(entry)
        for row in merge() if held else ():
            rows.append(row)
            if len(rows) >= EMIT_ROWS:
                yield _batch(rows, _MERGED)
                rows.clear()
        if rows:
            yield _batch(rows, _MERGED)

    merged = steps.write(known.repartition("part").sortWithinPartitions("part", "run", "ord").mapInArrow(run, _MERGED), "nodes", spread=True)
    steps.drop(ranges)
    borders = merged.where("border IS NOT NULL")
    whole = steps.write(_joined_borders(borders), "borders")
    names = [f.split()[0] for f in _NODE.split(", ")]
    parents = borders.select("part", F.col("border").alias("parent_border"), "path").join(whole.select("path", F.col("conv_id").alias("above")), "path").drop("path")
    below = merged.where("parent_border IS NOT NULL").join(parents, ["part", "parent_border"]).withColumn("parent_conv_id", F.col("above"))
    inner = merged.where("border IS NULL AND parent_border IS NULL")
    return inner.select(names).unionByName(below.select(names)).unionByName(whole.select(names))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT i.conv_id, conv_id - conv_id % 100 AS base, {crc_sql("i.conv_id::VARCHAR")} % 6 AS h, coalesce(b.size, 0) AS size
  FROM (SELECT DISTINCT conv_id FROM turns) i CROSS JOIN crc_table LEFT JOIN (SELECT conv_id AS base_id, count(*) AS size FROM turns GROUP BY 1) b ON b.base_id = i.conv_id - i.conv_id % 100
), rebuilt AS (
  SELECT i.conv_id, t.n AS depth, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.n <= i.h
  UNION ALL
  SELECT i.conv_id, least(i.h, i.size) + t.n - i.h, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.n > i.h
), paths AS (
  SELECT conv_id, depth, length(text) AS size, array_to_string(list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS key FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), members AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM paths
), nodes AS (
  SELECT key, depth, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY key, depth
), kids AS (
  SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT above.key, sum((v.n_convs - 1) * v.size)::BIGINT AS saved_tokens, count(*) FILTER (kids.n_children IS NULL) AS n_leaves
  FROM nodes v JOIN paths above ON above.conv_id = v.conv_id AND above.depth <= v.depth LEFT JOIN kids ON kids.parent = v.key GROUP BY above.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN kids k ON k.parent = n.key LEFT JOIN nodes p ON p.key = n.parent
"""
