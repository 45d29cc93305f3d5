"""A ledger of a model's answers, so that a prompt that was answered is never asked again.

Answers lie in a folder as (key, answer), the key being a hash of the prompt.
Prompts are asked once each, those that the ledger lacks, in rounds of about
``batch``, or of a part in ROUNDS of them if that is more, that are written one
by one: a run that breaks off loses the round that it was in, a lost task only
its own part of one, and a rerun asks what is left.  What the model failed at is not written and is asked next time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import work
from . import provider as models

#: The most rounds of a call: each is a job, so their number must not grow with the prompts.
ROUNDS = 16
_KINDS = {"answers": "key string, value string", "vectors": "key string, value array<double>"}


class Ledger:
    def __init__(self, spark: SparkSession, path: str, batch: int = 5000):
        self.spark, self.path, self.batch = spark, path.rstrip("/"), batch

    def read(self, kind: str = "answers") -> DataFrame:
        """(key, value) of all that was answered by now; two runs at once may have asked the same, so the least of equal keys counts."""
        # the files by name: a plan that reads the grown folder, too, must not take the two readings for the same
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/part-*")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        rows = self.spark.read.schema(_KINDS[kind]).parquet(f"{self.path}/{kind}/part-*") if there is not None and len(there) else self.spark.createDataFrame([], _KINDS[kind])
        return rows.groupBy("key").agg(F.min("value").alias("value"))

    def _fill(self, kind: str, wanted: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> None:
        """Asks for the (key, text) that the ledger lacks; ``ask`` adds ``value``.  A round moves each of its texts once: to the task that asks it."""
        known = self.read(kind).select("key")
        rounds = min(-(-wanted.select("key").distinct().join(known, "key", "left_anti").count() // self.batch), ROUNDS)
        tasks = self.spark.sparkContext.defaultParallelism
        for k in range(rounds):
            of = lambda rows: rows.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).repartition(tasks, "key")  # noqa: B023, E731
            todo = of(wanted).join(of(known), "key", "left_anti").dropDuplicates(["key"])
            ask(todo.select("key", "text")).where("value IS NOT NULL").select("key", "value").write.mode("append").parquet(f"{self.path}/{kind}")

    def _answered(self, kind: str, df: DataFrame, text: Column, out: str, salt: str, ask) -> DataFrame:
        # kept: what they come from is worked out once, not in each round; rows without a text are not moved
        rows = work.kept(df.withColumn("_key", F.when(text.isNotNull(), F.sha2(F.concat(F.lit(f"{salt}\n"), text), 256))))
        asked = rows.where("_key IS NOT NULL")
        self._fill(kind, asked.select(F.col("_key").alias("key"), text.alias("text")), ask)
        told = self.read(kind).select(F.col("key").alias("_key"), F.col("value").alias(out))
        none = rows.where("_key IS NULL").drop(out).withColumn(out, F.lit(None).cast(told.schema[out].dataType))
        return asked.drop(out).join(told, "_key", "left").unionByName(none).drop("_key")

    def generate(self, df: DataFrame, prompt: str | Column, answer: str, provider: Callable[[], models.ModelProvider], salt: str = "", **more) -> DataFrame:
        """df with the model's answer to each prompt, null where it failed or the prompt is null.  The same prompt with another ``salt`` is asked anew."""
        text = F.col(prompt) if isinstance(prompt, str) else prompt
        return self._answered("answers", df, text, answer, salt, lambda rows: models.generate(rows, "text", "value", provider, **more))

    def embed(self, df: DataFrame, text: str, vector: str, provider: Callable[[], models.ModelProvider], salt: str = "", **more) -> DataFrame:
        """df with a vector for each text (its first 8000 characters); null where it failed."""
        return self._answered("vectors", df, F.substring(F.coalesce(F.col(text), F.lit("")), 1, 8000), vector, salt, lambda rows: models.embed(rows, "text", "value", provider, **more))
