"""Ranking, ordered collections and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def rank_candidates(items: DataFrame, labels: DataFrame, top: int = 50) -> DataFrame:
    """Items that pass the filter with their score, best first; ties by newest, then id.  The filter comes before the top-k."""
    both = items.drop("exclude_reason").join(labels, "id", "left")
    label = F.coalesce("label", F.lit("OTHER"))
    penalty = scoring.noise_penalty(F.col("title"), label, F.col("source"), F.col("evidence_spans"), F.col("exclude_reason"))
    score = scoring.signal_score(F.col("audience_fit"), F.col("pain_intensity"), F.col("actionability"), F.col("confidence"), penalty)
    kept = both.where(scoring.passes_filter(label, F.col("audience_fit"), F.col("pain_intensity"), F.col("actionability"), F.col("confidence")))
    return kept.withColumn("signal_score", score).orderBy(F.desc("signal_score"), F.desc_nulls_last("published_at"), "id").limit(top)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def first_distinct(df: DataFrame, keys: list[str], value: str, order: str, n: int, name: str) -> DataFrame:
    """(keys, name): the first n different values of each key in the given order, without null and ''.

    Values are reduced to their first place before they are gathered, so no list grows with a key.
    """
    first = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.min(order).alias("_at"))
    few = top_per_key(first, keys, [F.col("_at"), F.col(value)], n, "_rank")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v")))), lambda x: x["v"])
    return few.groupBy(*keys).agg(listed.alias(name))


def greedy_disjoint(rows: Column, keys: str, keep=None) -> Column:
    """Of an ordered array of structs, those whose ``keys`` meet none of those kept before (or for which ``keep`` holds)."""

    def step(state: Column, row: Column) -> Column:
        fresh = ~F.arrays_overlap(state["seen"], row[keys])
        if keep is not None:
            fresh = fresh | keep(row)
        ok = F.coalesce(fresh, F.lit(True))
        return F.struct(
            F.when(ok, F.array_union(state["seen"], row[keys])).otherwise(state["seen"]).alias("seen"),
            F.when(ok, F.array_append(state["ids"], row["ordinal"])).otherwise(state["ids"]).alias("ids"),
        )

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(rows, start, step)["ids"]


def gate_fallback(candidates: DataFrame, n: int = 20) -> DataFrame:
    """The first n pain or discussion candidates by ordinal are featured; all others are rejected."""
    fit = candidates.where(F.col("label").isin("PAIN", "DISCUSSION")).orderBy("ordinal").limit(n).select("id", F.lit(True).alias("featured"))
    return candidates.join(fit, "id", "left").withColumn("featured", F.coalesce("featured", F.lit(False)))


def source_weights(rows: DataFrame) -> DataFrame:
    """Weight per trimmed source, the heaviest first; null and 0 count as 1."""
    w = F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("source_value", F.trim("source_value")).where("source_value <> ''").groupBy("source_type", "source_value").agg(F.sum(w).alias("weight")).orderBy(F.desc("weight"), "source_value", "source_type")
