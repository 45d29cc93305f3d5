"""An extension: the batch upsert, fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import work
from ..operators.store import last_of, overwrite_partitions


def daily_items(stream: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Events once per key within the lateness, with their date."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]).withColumn("date", F.to_date(time))


def write_daily(stream: DataFrame, path: str, checkpoint: str, key: str, time: str):
    """Starts a query that merges each micro-batch into the day partitions that it touches."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path).join(batch.select("date").distinct(), "date", "left_semi")
            batch = batch.unionByName(old)
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # kept: the table is overwritten while it is read
        overwrite_partitions(work.kept(last_of(batch, [key], [F.desc(time)])), path, "date")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
