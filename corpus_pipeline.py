"""From raw documents to training ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``.  Empty and null texts, repeated rows and extra
columns are handled as each operator's docstring says; extra columns, whatever
their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import jaccard, mixing, pieces, substring, toxicity
from oreline.llm.common import Steps, id_keys, kind_of, text_of

KEYS = ["hi", "lo"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, scores below its threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model) < toxicity.THRESHOLD)


def _keyed(docs: DataFrame, **more) -> DataFrame:
    """Whole rows as one column ``row``, with the keys of their texts and more; so no column of docs can clash."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64(text_of()).alias("hi"), F.hash(text_of()).alias("lo"), *[c.alias(n) for n, c in more.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id, or any of those without one if no id is there.  Documents without a word are not duplicates of each other."""
    _, texts = jaccard.near_duplicates(docs)
    kind = kind_of(docs, "doc_id")
    stays = texts.where((F.col("n_words") > 0) & F.col("stays")).select(*KEYS, *[c.alias(n) for n, c in id_keys(kind, "first_id").items()])
    worded = text_of().rlike(r"[^\x20\x09-\x0D]")
    keys = ["_id", "_null", *KEYS]
    # the join has rows of one id and text together already, so repeated rows cost no further exchange
    kept = _keyed(docs.where(worded), **id_keys(kind)).join(stays, keys, "left_semi").dropDuplicates(keys)
    return kept.select("row.*").unionByName(docs.where(~worded))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat anywhere; a text that loses nothing stays as it is."""
    _, texts = substring.repeated_substrings(docs)
    cut = Steps(spark, "pipeline").write(texts.where("n_removed > 0").select(*KEYS, "kept_text"), "cut")
    joined, rest = _keyed(docs).join(cut, KEYS, "left"), F.col("kept_text")
    new = {"text": rest, "n_chars": F.length(rest).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": rest}
    old = {c: F.col("row")[c] for c in docs.columns}
    return joined.select(*[(F.when(rest.isNull(), x).otherwise(new[c]) if c in new else x).alias(c) for c, x in old.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the target shares of sources, languages and topics."""
    return mixing.mix(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends, source_bytes, spans_tile, decoded_sha256): ids with the end id last, the bytes of the text that each other piece stands for, and a digest of the decoded text."""
    return pieces.encode_pieces(docs, pieces.public_model(), outputs=("n_tokens", "ids", "starts", "ends", "source_bytes", "spans_tile", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Model fitting, classes of near duplicates and piece encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    steps = Steps(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = steps.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
