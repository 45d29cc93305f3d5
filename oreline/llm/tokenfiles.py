"""Token counts: a separator scan over flat, unindexed token files.

Method.  A token file is one run of little-endian ids in which an
end-of-document id follows each document; nothing says where documents start.
Files are cut into blocks of fixed size by their length alone, and a task reads
the byte range of its block.  The positions of the end id in a block are found
by one vectorised comparison, which gives the lengths of the documents that end
there; what follows the last end is open.  Open parts are stitched across
blocks by a prefix scan over one small row per block: a block's first document
also has the open parts of the blocks since the last end.  The scan runs over
segments of SEGMENT blocks first and then over the segments, so a file of any
length is no single task.

Defined cases.  A file without ids has no documents.  Ids after the last end
of a file are a document without an end (``closed`` false).  Two ends in a row
are a document of the end id only.  Counts include the end id.  Bytes after the
last whole id of a file are not an id and are left out.  Ids that the width
cannot hold raise an error when a file is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, binaries
from .pieces import _encoded, codec, public_model

BLOCK_IDS, SEGMENT = 1 << 20, 1024
_PIECE = 1 << 22


def token_rows(docs: DataFrame, model_path: str, width: int = 2, text_col: str = "text") -> DataFrame:
    """(data): the ids of each document without the end id, as little-endian bytes, in the order of docs."""

    def run(batches):
        c = codec(model_path)
        if c.whole.get_piece_size() > 1 << 8 * width:
            raise ValueError(f"{c.whole.get_piece_size()} ids do not fit in {width} bytes")
        for batch in batches:
            data = [ids.astype(f"<u{width}").tobytes() for _, _, ids in _encoded(c, binaries(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "data binary")


def write_files(rows: DataFrame, end_id: int, path: str, width: int = 2) -> None:
    """A flat file per partition of rows (data), in its order.

    Spark's text writer puts raw bytes and, after each row, the end id as the
    separator, so tasks need no file system of their own and a lost one is
    simply run again.
    """
    end = end_id.to_bytes(width, "little")
    if max(end) >= 0x80:
        raise ValueError(f"the bytes of end id {end_id} are not ASCII")
    rows.select(F.col("data").cast("string").alias("value")).write.option("lineSep", end.decode()).text(path)


def positions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, position, doc_id): where write_files puts each document of a table that is scanned in the same way again, as one of Parquet files is."""
    row = F.monotonically_increasing_id()
    return docs.select(F.shiftright(row, 33).cast("int").alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("position"), F.col(id_col).alias("doc_id"))


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, first, size): byte ranges of flat files, from their lengths alone."""
    step = width * block_ids
    # only the listing is read here, not the files
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.col("length") - F.col("length") % width).alias("length")).where("length > 0")
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    return cut.select("file", "block", (F.col("block") * step).alias("first"), F.least(F.lit(step), F.col("length") - F.col("block") * step).alias("size"))


def scan_blocks(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, block, lengths, tail, ends): lengths of the documents that end in each block, and the ids after the last end."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            files, firsts, sizes = (batch.column(c).to_pylist() for c in ("file", "first", "size"))
            for k, (file, first, size) in enumerate(zip(files, firsts, sizes, strict=True)):
                system, name = fs.FileSystem.from_uri(file if "://" in file else file.replace(":", "://", 1))
                ends = []
                with system.open_input_file(name) as f:
                    for at in range(0, size, _PIECE):
                        ids = np.frombuffer(f.read_at(min(_PIECE, size - at), first + at), dtype=f"<u{width}")
                        ends.append(np.flatnonzero(ids == end_id) + at // width)
                at = np.concatenate(ends)
                lengths = np.diff(at, prepend=-1)
                tail = size // width - 1 - int(at[-1]) if len(at) else size // width
                yield pa.RecordBatch.from_arrays([batch.column("file")[k : k + 1], batch.column("block")[k : k + 1], pa.array([lengths], pa.list_(pa.int64())), pa.array([tail], pa.int64()), pa.array([len(at)], pa.int64())], ["file", "block", "lengths", "tail", "ends"])

    return blocks.select("file", "block", "first", "size").mapInArrow(run, "file string, block long, lengths array<long>, tail long, ends long")


def stitch(blocks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, block, before, carry, last): documents that end before each block, and ids open at its start, of (file, block, tail, ends)."""
    part = blocks.withColumn("segment", F.floor(F.col("block") / segment))
    inside = Window.partitionBy("file", "segment").orderBy("block")
    # since: blocks with an end so far; what is open is the sum of the tails since the last of them
    part = part.withColumns({"since": F.sum((F.col("ends") > 0).cast("int")).over(inside), "ended": F.sum("ends").over(inside)})
    part = part.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "segment", "since").orderBy("block")))
    step = part.groupBy("file", "segment").agg(F.sum("ends").alias("ends"), F.max_by("open", "block").alias("open"), F.max("block").alias("top"))
    over = Window.partitionBy("file").orderBy("segment")
    step = step.withColumns({"since": F.sum((F.col("ends") > 0).cast("int")).over(over), "earlier": F.sum("ends").over(over) - F.col("ends"), "end": F.lead("segment").over(over).isNull()})
    step = step.withColumn("open", F.sum("open").over(Window.partitionBy("file", "since").orderBy("segment")))
    step = step.select("file", "segment", "earlier", F.coalesce(F.lag("open").over(over), F.lit(0)).alias("brought"), F.when(F.col("end"), F.col("top")).alias("top"))
    own = F.coalesce(F.lag("open").over(inside), F.lit(0))
    none_yet = F.coalesce(F.lag("since").over(inside), F.lit(0)) == 0
    part = part.withColumns({"own": own, "none_yet": none_yet}).join(step, ["file", "segment"])
    carry = F.col("own") + F.when(F.col("none_yet"), F.col("brought")).otherwise(0)
    return part.select("file", "block", (F.col("earlier") + F.col("ended") - F.col("ends")).alias("before"), carry.alias("carry"), (F.col("block") == F.coalesce("top", F.lit(-1))).alias("last"))


def count_tokens(scanned: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, position, n_tokens, closed): documents in the order of each file, from scan_blocks."""
    if not hasattr(scanned, "_oreline_path"):
        scanned = Steps(scanned.sparkSession, "tokens").write(scanned, "scan")
    place = stitch(scanned.select("file", "block", "tail", "ends"), segment)
    both = scanned.join(place, ["file", "block"])
    first = F.when(F.col("at") == 0, F.col("carry")).otherwise(0)
    ended = both.select("file", "before", "carry", F.posexplode("lengths").alias("at", "n")).select("file", (F.col("before") + F.col("at")).alias("position"), (F.col("n") + first).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    return ended.unionByName(both.where("last").select("file", (F.col("before") + F.col("ends")).alias("position"), rest.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from flat files made of the documents; which document is where follows from the order of the table, not from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, steps = public_model(), Steps(spark, "tokens")
    end = codec(model).end
    path = steps.path("files")
    write_files(token_rows(docs, model), end, path)
    blocks = read_blocks(spark, path)
    counts = count_tokens(steps.write(scan_blocks(blocks.repartition(spark.sparkContext.defaultParallelism, "file", "block"), end), "scan"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    # an outer join: were the orders ever to differ, it would show
    return counts.withColumn("part", part).join(positions(docs), ["part", "position"], "full_outer").select("doc_id", F.col("part").alias("file"), "position", "n_tokens")
