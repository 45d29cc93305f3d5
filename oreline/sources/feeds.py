"""Feeds in RSS and Atom: one parser for landed files, stored bytes, and a data source that fetches a feed in each partition.

A feed that cannot be fetched or parsed gives one row with ``error`` set and no
entry; the others are not touched by it.  Entries have the fields of
``FEED_ENTRY``; an Atom link is its address with rel alternate, or without rel,
and a feed's address is what it says of itself, so entries keep their ids
wherever the file is landed.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("title", "link", "id", "summary", "description", "author", "published", "updated")
SCHEMA = "feed_url string, ordinal long, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"
MOST_ENTRIES = 20
#: Feeds that are objects of Python at a time, and bytes of them: a batch of Arrow has as many as 10,000.
MOST_FEEDS, MOST_BYTES = 256, 4 << 20
_NAMES = {"guid": "id", "pubdate": "published", "creator": "author", "date": "published", "content": "summary", "encoded": "summary", "issued": "published", "modified": "updated"}


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _link(node) -> tuple[int, str]:
    """(rank, address) of a link: the lower rank is the better one."""
    address = (node.get("href") or "".join(node.itertext())).strip()
    return {"alternate": 0, None: 1, "self": 3}.get(node.get("rel"), 2), address


def _entry(node) -> dict[str, str]:
    out: dict[str, str] = {}
    links = []
    for child in node:
        name = _local(child.tag)
        if name == "link":
            links.append(_link(child))
            continue
        text = "".join(child.itertext()).strip() if name != "author" else (next(("".join(x.itertext()) for x in child if _local(x.tag) == "name"), None) or child.text or "").strip()
        name = _NAMES.get(name, name)
        if text and name in FIELDS and name not in out:
            out[name] = text
    good = [a for rank, a in sorted(links, key=lambda x: x[0]) if a and rank < 3]
    return out | ({"link": good[0]} if good else {})


def parse_feed(content: bytes, address: str, most: int = MOST_ENTRIES) -> list[tuple]:
    """Rows of SCHEMA: the first entries of a feed, or one row with the error."""
    try:
        root = ElementTree.fromstring(content)
        if _local(root.tag) not in ("rss", "feed", "rdf"):
            raise ValueError(f"no feed: {root.tag}")
        head = next((x for x in root if _local(x.tag) == "channel"), root)
        links = [_link(x) for x in head if _local(x.tag) == "link"]
        own = [a for rank, a in links if rank == 3 and a] or [a for _, a in sorted(links, key=lambda x: x[0]) if a] or [address]
        entries = [x for x in root.iter() if _local(x.tag) in ("item", "entry")][:most]
        return [(own[0], k, *(e.get(f) for f in FIELDS), None) for k, e in enumerate(map(_entry, entries))]
    except Exception as e:
        return [(address, None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}"[:500])]


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of feeds of at most MOST_FEEDS and, but for a single feed, MOST_BYTES."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("c")), 0).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            if i > at and (i - at == MOST_FEEDS or size + n > MOST_BYTES):
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if sizes:
            yield batch.slice(at)


def parse_feeds(rows: DataFrame, address: str = "path", content: str = "content", most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of feeds given as bytes, one feed a row."""
    kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(FIELDS) + 1)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for part in _parts(batches):
            out = [r for a, c in zip(part.column("a").to_pylist(), part.column("c").to_pylist(), strict=True) for r in parse_feed(c or b"", a, most)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select(F.col(address).alias("a"), F.col(content).cast("binary").alias("c")).mapInArrow(run, SCHEMA)


def read_feeds(spark: SparkSession, path: str, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of landed feed files, from any file system that Spark reads."""
    return parse_feeds(spark.read.format("binaryFile").load(path), "path", "content", most)


class _Feed(InputPartition):
    def __init__(self, address: str):
        self.address = address


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.addresses = json.loads(options["addresses"])
        self.most, self.timeout = int(options.get("most", MOST_ENTRIES)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [_Feed(a) for a in self.addresses]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with urllib.request.urlopen(partition.address, timeout=self.timeout) as answer:
                content = answer.read()
        except Exception as e:
            return iter([(partition.address, None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}"[:500])])
        # what was fetched from an address is a feed of that address
        return iter([(partition.address, *r[1:]) for r in parse_feed(content, partition.address, self.most)])


class FeedSource(DataSource):
    """spark.read.format("feeds").option("addresses", <JSON list>): a partition a feed, so one that fails or hangs holds up nobody."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


def fetch_feeds(spark: SparkSession, addresses: list[str], most: int = MOST_ENTRIES, timeout: float = 30) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("feeds").option("addresses", json.dumps(addresses)).option("most", most).option("timeout", timeout).load()
