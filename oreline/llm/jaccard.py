"""N-gram Jaccard join by chosen paths.

Method.  A text is the set of its ``n``-word shingles.  Sets are embedded as
``SKETCH`` minhash tokens, of which two sets share a fraction equal to their
Jaccard similarity in expectation.  One run of the join starts with all sets
in one bucket and splits it by a sampled shared token; a bucket that is still
large is split again by further sampled tokens, along its own path: those
``SPLITS`` of ``TRIED`` sampled coordinates that separate its members best.
Buckets of at most ``SMALL`` sets are compared by brute force.  A large bucket
whose members are alike on average, which no split can separate, becomes one
group of candidates, without any comparison here.  Runs are repeated, each
with a root token of its own, until a pair at the threshold shares no root
with a probability below ``1 - recall``: (1 - threshold) ** runs.

The brute-force step compares sketches and keeps one spanning edge per join of
two groups, never all pairs.  Inside the components of these edges every pair
is then checked on the exact shingle sets, in blocks of bounded size, and
links are counted, not listed.

Defined cases.  Words are ``[^\\x20\\x09-\\x0D]+``.  Null text is empty.  A
text of 1 to n - 1 words has one shingle, its words.  Texts without a word
have no links and are a class each (of one row, or of equal rows).  Equal
texts are handled once, with a copy count; each copy links to every other.
Rows without an id are compared and counted like others; a class in which no
row has an id has a null class_id.  Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, binaries, components, id_keys, keyed, kind_of
from .substring import chunks
from .wordhash import hash_words, mix, window_hashes

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999999
SKETCH, SMALL, TRIED, SPLITS, ALIKE, DEPTH = 64, 512, 8, 4, 0.6, 12
_SLACK = 5.0
_BLOCK_SHINGLES = 4_000_000


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The set of shingle hashes of a text's word hashes."""
    if len(words) >= n:
        return np.unique(window_hashes(words, n))
    return mix(window_hashes(words, len(words)) + np.uint64(len(words))) if len(words) else np.zeros(0, dtype=np.uint64)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(rows: DataFrame, n: int = NGRAM) -> DataFrame:
    """(doc_id, hi, lo, n_words, sketch): SKETCH minhash tokens of 32 bits of each row's shingle set, as bytes; empty for no shingles."""
    factor = _multipliers()

    def run(batches):
        for batch in batches:
            text = binaries(batch.column("text"))
            out, count = [], []
            for a, b in chunks(text):
                off, (words,) = hash_words(text[a:b])
                for i in range(b - a):
                    s = shingles(words[off[i] : off[i + 1]], n)
                    count.append(int(off[i + 1] - off[i]))
                    low = [np.min([(s[k : k + 65536] * f).min() for k in range(0, len(s), 65536)]) for f in factor] if len(s) > 2048 else (s[:, None] * factor).min(0) if len(s) else []
                    out.append((np.asarray(low, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hi"), batch.column("lo"), pa.array(count, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "hi", "lo", "n_words", "sketch"])

    return rows.select("doc_id", "hi", "lo", "text").mapInArrow(run, f"doc_id {kind_of(rows, 'doc_id')}, hi long, lo int, n_words long, sketch binary")


def _token(at) -> F.Column:
    """The token at coordinate ``at`` of a sketch."""
    return F.substring("sketch", F.lit(1) + 4 * at, F.lit(4)) if not isinstance(at, int) else F.substring("sketch", 1 + 4 * at, 4)


def _buckets(sets: DataFrame, runs: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(bucket, node) of each leaf bucket a set ends in, and star edges (a, b) of the large buckets whose members are alike.

    A bucket with a single set is dropped at once.  Only keys move here;
    sketches are joined to the members of large buckets and, later, to leaves.
    """
    level = sets.select("node", F.explode(F.array(*[F.xxhash64(F.lit(r), _token(r % SKETCH)) for r in range(runs)])).alias("bucket"))
    leaves, stars = [], []
    for depth in range(DEPTH + 1):
        level = steps.write(level, "level")
        sized = steps.write(level.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "sizes")
        # a merge join at every size: the sizes table grows with the input
        leaves.append(steps.write(level.join(sized.where(F.col("size") <= SMALL).select("bucket").hint("merge"), "bucket").select("bucket", "node"), "leaves"))
        large = sized.where(F.col("size") > SMALL)
        if large.limit(1).count() == 0:
            break
        picks = F.array(*[_token(F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(SKETCH)).cast("int")) for k in range(TRIED)])
        tokens = steps.write(level.join(large, "bucket").join(sets.select("node", "sketch"), "node").select("bucket", "size", "least", "node", picks.alias("tokens")), "inside")
        # the chance that two members share the token at a coordinate; its mean is the bucket's mean similarity
        square = F.col("n").cast("double") * F.col("n")
        rates = [tokens.groupBy("bucket", "size", F.get("tokens", F.lit(k)).alias("token")).agg(F.count("*").alias("n")).groupBy("bucket", "size").agg(F.sum(square).alias("same")).select("bucket", (F.col("same") / F.col("size") / F.col("size")).alias("rate"), F.lit(k).alias("k")) for k in range(TRIED)]
        verdict = functools.reduce(DataFrame.unionByName, rates).groupBy("bucket").agg(F.avg("rate").alias("alike"), F.slice(F.sort_array(F.collect_list(F.struct("rate", "k"))), 1, SPLITS)["k"].alias("best"))
        verdict = steps.write(verdict.select("bucket", "best", ((F.col("alike") >= ALIKE) | F.lit(depth == DEPTH)).alias("dense")), "verdict")
        stars.append(steps.write(tokens.select("bucket", "least", "node").join(verdict.where("dense").select("bucket"), "bucket").where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")), "stars"))
        split = tokens.join(verdict.where("not dense").select("bucket", "best"), "bucket")
        level = split.select("node", F.explode(F.transform("best", lambda k: F.xxhash64("bucket", k, F.get("tokens", k)))).alias("bucket"))
    none = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    return functools.reduce(DataFrame.unionByName, leaves), functools.reduce(DataFrame.unionByName, stars, none)


def _pairs_of_blocks(df: DataFrame) -> DataFrame:
    """Sends each row to every pair of blocks of its group that holds its block: (left, right) with left <= right."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return df.select("*", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")


def _spanning(same: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (least node, other node) of each connected part of the graph with boolean adjacency ``same``: stars, which need few rounds to merge."""
    todo = np.ones(len(nodes), dtype=bool)
    out = []
    for i in range(len(nodes)):
        if not todo[i]:
            continue
        todo[i], front, part = False, [i], [i]
        while front:
            new = np.flatnonzero(same[front.pop()] & todo)
            todo[new] = False
            front += new.tolist()
            part += new.tolist()
        if len(part) > 1:
            least = min(nodes[k] for k in part)
            out += [(least, nodes[k]) for k in part if nodes[k] != least]
    return out


def _alike(sk: np.ndarray) -> np.ndarray:
    """How many tokens each two of the sketches share."""
    if len(sk) <= 40:
        return (sk[:, None, :] == sk[None, :, :]).sum(2)
    out = np.zeros((len(sk), len(sk)), dtype=np.uint8)
    for c in range(SKETCH):
        out += sk[:, c][:, None] == sk[:, c][None, :]
    return out


def _edges(leaves: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning edges of the pairs in a leaf (bucket, node, sketch) whose sketches agree on nearly the threshold or more.

    Most leaves hold a few sets, so a task goes through its sorted leaves batch
    by batch, and leaves of two sets are compared all at once; what is held is
    a batch and one leaf.
    """
    need = threshold * SKETCH - _SLACK * math.sqrt(SKETCH * threshold * (1 - threshold))

    def compare(starts: np.ndarray, ends: np.ndarray, nodes: np.ndarray, sk: np.ndarray) -> list[tuple[int, int]]:
        two = starts[ends - starts == 2]
        two = two[(sk[two] == sk[two + 1]).sum(1) >= need]
        out = list(zip(nodes[two].tolist(), nodes[two + 1].tolist(), strict=True))
        for i, j in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            own, first = np.unique(nodes[i:j], return_index=True)
            mine = sk[i:j][first]
            if ((mine == mine[0]).sum(1) >= need).all():
                out += [(int(own[0]), x) for x in own[1:].tolist()]
            else:
                out += _spanning(_alike(mine) >= need, own)
        return out

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "node")])
            sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, SKETCH)
            if held is not None:
                key, sk = np.concatenate([held[0], key], axis=1), np.concatenate([held[1], sk])
            edge = np.flatnonzero(key[0, 1:] != key[0, :-1]) + 1
            if len(edge):
                yield _pairs(compare(np.append(0, edge[:-1]), edge, key[1], sk))
                key, sk = key[:, edge[-1] :], sk[edge[-1] :]
            held = key, sk
        if held is not None:
            yield _pairs(compare(np.array([0]), np.array([len(held[1])]), held[0][1], held[1]))

    return leaves.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long").where("a <> b")


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exact(sets: DataFrame, threshold: float, n: int, tasks: int) -> DataFrame:
    """(a, b, links): every pair of a component on its exact shingle sets, block pair by block pair.

    A row per set and block pair: ``links`` is the number of rows of the input
    that the other sets linked to it stand for, and (a, b) a spanning edge.
    """

    def brute(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        nodes, copies, block = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        off, (words,) = hash_words([t.encode() for t in pdf["text"]])
        own = [shingles(words[off[i] : off[i + 1]], n) for i in range(len(nodes))]
        size = np.array([len(s) for s in own])
        _, ids, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(len(nodes)), size)
        common = count[ids] > 1
        number = np.cumsum(count > 1) - 1
        ids, who = number[ids[common]], who[common]
        both = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        order = np.argsort(ids, kind="stable")
        ids, who = ids[order], who[order]
        width = max(1, 32_000_000 // (4 * len(nodes)))
        for first in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
            a, b = np.searchsorted(ids, [first, first + width])
            part = np.zeros((len(nodes), width), dtype=np.float32)
            part[who[a:b], ids[a:b] - first] = 1
            both += part @ part.T
        # intersection / union >= threshold, in whole numbers
        union = size[:, None] + size[None, :] - both
        link = both * 1.0 >= np.float64(threshold) * union - 1e-9
        np.fill_diagonal(link, False)
        if left != right:  # pairs inside a block belong to the task (block, block)
            link &= block[:, None] != block[None, :]
        out = pd.DataFrame({"a": nodes, "b": nodes, "links": (link * copies[None, :]).sum(1)})
        edges = _spanning(link, nodes)
        return pd.concat([out, pd.DataFrame({"a": [x for x, _ in edges], "b": [y for _, y in edges], "links": 0})]).astype("int64")

    keys = ["component", "left", "right"]
    # a fixed count: few bytes are much work here, so partitions are not to be put together by size
    return _pairs_of_blocks(sets).repartition(tasks, *keys).groupBy(*keys).applyInPandas(brute, "a long, b long, links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Classes of texts connected by links, a link being a shingle Jaccard similarity of ``threshold`` or more.

    Returns (rows, texts): ``rows`` is (doc_id, hi, lo) of every input row and
    ``texts`` is (hi, lo, first_id, copies, n_words, class_id, stays, n_links)
    of every distinct text.  class_id is the least id in the class, null where
    no row of the class has an id; stays is true for one text of each class,
    the one with the least id (of texts without one, the least key); n_links
    counts rows linked to a row of the text, its copies included.
    """
    runs = min(SKETCH, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    steps = Steps(docs.sparkSession, "jaccard")
    rows = keyed(docs, id_col, text_col)
    # a text's node is a number of its own, fixed once this table is written
    sets = steps.write(sketches(rows, n).groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "sets")
    worded = sets.where("n_words > 0").select("node", "sketch")
    leaves, stars = _buckets(worded, runs, steps)
    near = components(_edges(leaves.join(worded, "node"), threshold).unionByName(stars), steps)
    members = steps.write(sets.join(near, "node").select("hi", "lo", "node", "first_id", "copies", "n_words", F.col("root").alias("component")), "members")
    total = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_words").alias("w"))
    total = total.select("component", "m", F.greatest(F.ceil(F.col("m") / SMALL), F.ceil(F.col("w") / _BLOCK_SHINGLES)).cast("int").alias("blocks"))
    total = steps.write(total, "totals")
    dealt = total.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(dealt / SMALL))
    blocks = steps.write(members.join(total.drop("m"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
    keys = blocks.select("hi", "lo", F.col("first_id").alias("doc_id"), "component", "node", "copies", "block", "blocks")
    # a merge join at every size: the candidates grow with the input; it has repeated rows together already
    named, at = id_keys(kind_of(rows, "doc_id")), ["hi", "lo", "_id", "_null"]
    texts = steps.write(rows.where("text is not null").withColumns(named).drop("doc_id").join(keys.withColumns(named).drop("doc_id").hint("merge"), at).dropDuplicates(at).select("component", "node", "copies", "block", "blocks", "text"), "candidates")
    checked = steps.write(_exact(texts, threshold, n, tasks), "links", spread=True)
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    group = components(checked.where("a <> b").select("a", "b"), steps)
    all_sets = sets.drop("sketch").join(links, "node", "left").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    all_sets = steps.write(all_sets, "classed")
    place = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "hi", "lo")
    least = all_sets.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(place).alias("least"))
    least = steps.write(least.select("root", "class_id", F.col("least.hi").alias("_hi"), F.col("least.lo").alias("_lo")), "classes")
    stays = ((F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).alias("stays")
    out = all_sets.join(least, "root").select("hi", "lo", "first_id", "copies", "n_words", "class_id", stays, F.when(F.col("n_words") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return rows.select("doc_id", "hi", "lo"), steps.write(out, "result")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.join(texts, ["hi", "lo"]).select("doc_id", own.alias("class_id"), "n_links")
