"""What the training-data operators share: the work folder, written steps, text keys, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def workspace(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a folder of the warehouse, or in local mode (tests) a new local one, becomes the context's checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get(_KEY, None) or sc.getCheckpointDir()
    if not base:
        local = sc.master.startswith("local") and "cluster" not in sc.master
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="oreline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work")
        base = sc.getCheckpointDir()
    return base.rstrip("/")


class Steps:
    """Tables written to the work folder, or to ``base``, which cut lineage and survive lost executors.

    ``write`` returns the reread table.  ``drop`` deletes tables that no later
    step reads; those behind a returned DataFrame stay.  Bucketed tables are
    in the catalogue only while they are written or opened.

    A table gets at most TASKS files for each core, or an eighth of the shuffle
    partitions if that is more, as on a cluster that is still growing: every
    file costs several calls to the file system, and on a local one a process
    each.  What is put together runs one after the other, so memory is the same.
    """

    TASKS = 4

    def __init__(self, spark: SparkSession, tag: str, base: str | None = None):
        self.spark = spark
        self.base = base or f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd", bucket: tuple[int, *tuple[str, ...]] | None = None, spread: bool = False) -> DataFrame:
        """``spread`` keeps the partitions of df, whose work is dealt out already."""
        path = self.path(name)
        if bucket:
            n, *columns = bucket
            writer = df.write.option("compression", codec)
            table = f"w{uuid.uuid4().hex}"
            writer.option("path", path).format("parquet").bucketBy(n, *columns).sortBy(*columns).saveAsTable(table)
            out = self.spark.table(table)
            self.spark.sql(f"DROP TABLE {table}")  # the files stay
        else:
            most = max(self.TASKS * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
            (df if spread else df.coalesce(most)).write.option("compression", codec).parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        out._oreline_path = path
        tidy(self.spark)
        return out

    def open(self, path: str, schema: str, bucket: tuple[int, *tuple[str, ...]]) -> DataFrame:
        """A bucketed table written before, maybe by another session."""
        n, *columns = bucket
        table, keys = f"w{uuid.uuid4().hex}", ", ".join(columns)
        self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{path}'")
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        out._oreline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._oreline_path)
            p.getFileSystem(conf).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are written and no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: str = "text"):
    """The whole text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, hi, lo): 96 bits of two hash functions name a text, so equal texts can be grouped by narrow keys."""
    t = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return t.withColumns({"hi": F.xxhash64("text"), "lo": F.hash("text")})


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as in a schema."""
    return df.schema[column].dataType.simpleString()


def id_keys(kind: str, id_col: str = "doc_id") -> dict:
    """Columns _id and _null, which join equal ids of the type ``kind`` and also rows without one."""
    none = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    return {"_id": F.coalesce(F.col(id_col), none), "_null": F.col(id_col).isNull()}


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, root): each node of the undirected edges (a, b), with the smallest node of its component.

    Rounds of "every node takes the least root among its neighbours' roots,
    then its root's root"; each round is a written table.  Nodes without edges
    don't appear.  The number of rounds grows with the logarithm of the
    longest chain.  Only two numbers per round reach the driver.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = steps.write(both, "edges")
    state = steps.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hop = state.join(near, "node", "left").select("node", F.least("root", "near").alias("r"), F.col("root").alias("old"))
        # the root of the root: halves chains
        jump = state.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = hop.join(jump, "r", "left").select("node", F.least("r", "up").alias("root"), "old")
        new = steps.write(new, "roots")
        moved = new.where("root <> old").limit(1).count()
        steps.drop(state)
        state = new.drop("old")
        state._oreline_path = new._oreline_path
        if not moved:
            steps.drop(both)
            return state
