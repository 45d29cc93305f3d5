"""The first-come choice over a whole table: a row is kept unless it shares a key with an earlier row that is kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Links of undecided rows that one task may finish by itself; a long chain of conflicts is short of rows.
TAIL_LINKS = 50_000


def keep_disjoint(rows: DataFrame, order: str, keys: str, always: str | None = None, tail: int = TAIL_LINKS) -> DataFrame:
    """The rows kept, of rows with a unique ``order`` (long) and an array of ``keys``; rows without a key are kept, and those where ``always`` holds, whose keys count too.

    Equal to going through the rows in order with a set of the keys seen, by rounds over links (order, key): a row goes
    if an earlier kept one has one of its keys, and is kept if among the undecided it is the first of each of its
    keys.  A round is two aggregates, of which that by key is summed before it moves, so no list of keys or rows
    grows with the table.  What is left below ``tail`` links is finished in one task.
    """
    forced = F.coalesce(F.col(always), F.lit(False)) if always else F.lit(False)
    links = rows.select(F.col(order).alias("o"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), forced.alias("forced"))
    links = work.kept(links)
    free = F.coalesce(F.size(F.array_compact(keys)), F.lit(0)) < 1
    kept = work.kept(links.where("forced").select("o", "key"))
    chosen = work.kept(rows.where(free | forced).select(F.col(order).alias("o")))
    open_ = work.kept(links.where("NOT forced").select("o", "key"))
    while True:
        n = open_.count()
        taken = kept.groupBy("key").agg(F.min("o").alias("taken"))
        if n <= tail:
            last = _finish(open_.join(taken, "key", "left")) if n else chosen.limit(0)
            return rows.join(chosen.unionByName(last).select(F.col("o").alias(order)), order, "left_semi")
        first = open_.groupBy("key").agg(F.min("o").alias("first")).join(taken, "key", "left")
        state = open_.join(first, "key").groupBy("o").agg(F.max(F.coalesce(F.col("taken") < F.col("o"), F.lit(False))).alias("gone"), F.min(F.col("first") >= F.col("o")).alias("leads"))
        state = work.kept(state)
        new = state.where("leads AND NOT gone").select("o")
        chosen = work.kept(chosen.unionByName(new))
        kept = work.kept(kept.unionByName(open_.join(new, "o", "left_semi")))
        open_ = work.kept(open_.join(state.where("NOT leads AND NOT gone").select("o"), "o", "left_semi"))


def _finish(links: DataFrame) -> DataFrame:
    """(o) of the rows kept among a few links (key, o, taken), in their order."""

    def run(batches):
        seen: dict = {}
        out, row, own = [], None, []

        def close():
            if row is not None and not any((t is not None and t < row) or k in seen for k, t in own):
                out.append(row)
                seen.update(dict.fromkeys(k for k, _ in own))

        for batch in batches:
            for o, key, taken in zip(*(batch.column(c).to_pylist() for c in ("o", "key", "taken")), strict=True):
                if o != row:
                    close()
                    row, own = o, []
                own.append((key, taken))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["o"])

    return links.select(F.col("o").cast("long").alias("o"), "key", "taken").repartition(1).sortWithinPartitions("o").mapInArrow(run, "o long")
