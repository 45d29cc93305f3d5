"""The folder for work tables, and rows kept as they are now."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of the warehouse, or in local mode a new local one, which is then the context's too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        local = sc.master.startswith("local") and "cluster" not in sc.master
        base = "file://" + tempfile.mkdtemp(prefix="oreline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, written once and read again: what they come from is not run again, and a lost executor costs nothing.  Their order is not kept."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
