"""The engine's tables in a folder: scans by day, upserts, replacements, seeds.

Tables of one day's results (clusters, catalysts, reports) are partitioned by
day, and a write replaces the days it has.  Tables with keys across days
(items, labels, embeddings, seeds) are ``KeyedTable``: in partitions by day and
a hash of the key, of which a change rewrites those that hold its keys, under
versions, so readers never see half a write and a failed one changes nothing.
Items move to the day they are fetched anew; labels and vectors stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landed import CATALYST, CLUSTER, LABEL, RAW_ITEM, item_id
from ..sources.ledger import Ledger
from . import constraints, store, work
from .keyed import KeyedTable

_ITEM_RULES = {"url": "old", "evidence_snippets": "old"}
_LABEL_RULES = dict.fromkeys(("audience_fit", "pain_intensity", "actionability"), "coalesce")
SCHEMAS = {
    "raw_items": RAW_ITEM, "item_labels": LABEL, "embeddings": "raw_item_id string, embedding array<double>, model string",
    "interests": "id string, name string, description string", "interest_sources": "interest_id string, source_type string, source_value string, weight double",
    "clusters": CLUSTER, "cluster_items": "date date, cluster_id string, raw_item_id string", "catalysts": CATALYST + ", ordinal int", "reports": "date date, markdown string",
}
DAILY = ("clusters", "cluster_items", "catalysts", "reports")
#: An item's id is made of its source and source_id.
KEYS = {"raw_items": ["id"], "item_labels": ["raw_item_id"], "embeddings": ["raw_item_id"], "interests": ["name"], "interest_sources": ["interest_id", "source_type", "source_value"]}
SEEDS = ("interests", "interest_sources")
MAX_TEXT = 100_000


class Tables:
    """``strict`` tables keep the constraints of ``constraints.RULES``: rows that break one are not written but added to ``rejects``."""

    def __init__(self, spark: SparkSession, path: str, strict: bool = False):
        self.spark, self.base, self.strict = spark, path.rstrip("/"), strict

    # ---- files

    def ledger(self) -> Ledger:
        """What a model has answered for these tables."""
        return Ledger(self.spark, f"{self.base}/ledger")

    def keyed(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.base}/{name}", SCHEMAS[name], KEYS[name], slots=1 if name in SEEDS else 16, moves=name == "raw_items")

    def read(self, name: str) -> DataFrame:
        """A table, empty if nothing was written yet."""
        if name not in DAILY:
            return self.keyed(name).read().drop("day")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{name}") if there else self.spark.createDataFrame([], SCHEMAS[name])

    def _replace(self, name: str, df: DataFrame) -> None:
        store.overwrite_partitions(self._checked(name, store.align(df, SCHEMAS[name])), f"{self.base}/{name}", "date")

    def _upsert(self, name: str, new: DataFrame, rules: dict, day=None, last=None) -> None:
        """``last`` orders rows of one key, of which the first counts."""
        if self.strict and last:  # repeated keys are no offence
            new, last = store.last_of(new, KEYS[name], last), None
        self.keyed(name).retried(3, self._checked(name, store.align(new, SCHEMAS[name])), rules, day, last=last)

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows that keep the constraints; the others are added to the rejects."""
        if not self.strict:
            return rows
        rows, parents = work.kept(rows), {}
        for column, parent in constraints.RULES[name].parents:
            own = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("id"))
            parents[column] = self.read(parent).select("id").distinct() if parent in DAILY or KEYS[parent] != ["id"] else self.keyed(parent).known(own)
        told = work.kept(constraints.checked(name, rows, parents))
        constraints.rejects(name, told).write.mode("append").parquet(f"{self.base}/rejects")
        return told.where("_broken IS NULL").drop("_broken")

    def rejects(self) -> DataFrame:
        """(table_name, constraint_name, row) of what was not written."""
        return self.spark.read.schema(constraints.REJECTS).parquet(f"{self.base}/rejects")

    def delete_items(self, ids: DataFrame) -> None:
        """Deletes items (id) with their labels, vectors and memberships; the children go first, so that a crash leaves no child without its item."""
        ids = work.kept(ids.select("id").distinct())
        for name, column in constraints.CHILDREN["raw_items"]:
            if name in DAILY:
                rows = self.read(name)
                hit = [r[0] for r in rows.join(ids.withColumnRenamed("id", column), column, "left_semi").select("date").distinct().collect()]
                rest = rows.where(F.col("date").isin(hit)).join(ids.withColumnRenamed("id", column), column, "left_anti")
                rest = work.kept(rest)
                if hit:
                    store.overwrite_partitions(rest, f"{self.base}/{name}", "date")
                for day in set(hit) - {r[0] for r in rest.select("date").distinct().collect()}:
                    self.delete_day(name, day)
            else:
                self.keyed(name).remove(ids.withColumnRenamed("id", column))
        self.keyed("raw_items").remove(ids)

    # ---- writes

    def put_items(self, rows: DataFrame) -> None:
        """Inserts or updates items by (source, source_id); the first address and stored snippets stay.  Of repeated keys the newest counts."""
        new = rows.withColumns({"id": item_id(F.col("source"), F.col("source_id")), "text": F.substring("text", 1, MAX_TEXT), "title": F.coalesce("title", F.lit(""))})
        self._upsert("raw_items", new, _ITEM_RULES, F.to_date("fetched_at"), [F.desc_nulls_last("published_at"), F.col("text")])

    def put_snippets(self, rows: DataFrame) -> None:
        """Sets evidence_snippets of (id, evidence_snippets) where they aren't null; other ids are left out."""
        self.keyed("raw_items").retried(3, rows.select("id", "evidence_snippets").where("evidence_snippets IS NOT NULL"), insert=False)

    def put_labels(self, rows: DataFrame, day=None) -> None:
        """Inserts or updates labels; a null score keeps the old one, the reason to exclude is always the new one.  New ones are kept with those of ``day``."""
        self._upsert("item_labels", rows, _LABEL_RULES, F.lit(day).cast("date"))

    def put_embeddings(self, rows: DataFrame, day=None) -> None:
        self._upsert("embeddings", rows, {}, F.lit(day).cast("date"))

    def put_clusters(self, clusters: DataFrame, members: DataFrame) -> None:
        """Replaces the days of clusters and of their members (date, cluster_id, raw_item_id); repeated members count once."""
        self._replace("clusters", clusters)
        self._replace("cluster_items", members.dropDuplicates(["cluster_id", "raw_item_id"]))

    def add_clusters(self, clusters: DataFrame) -> None:
        store.align(clusters, SCHEMAS["clusters"]).write.mode("append").partitionBy("date").parquet(f"{self.base}/clusters")

    def add_members(self, members: DataFrame) -> None:
        """Adds members that are not there yet."""
        new = store.align(members, SCHEMAS["cluster_items"]).dropDuplicates(["cluster_id", "raw_item_id"])
        days = [r[0] for r in new.select("date").distinct().collect()]
        new = new.join(self.read("cluster_items").where(F.col("date").isin(days)), ["cluster_id", "raw_item_id"], "left_anti")
        # checkpoint: the table is written while it is read
        work.kept(new).write.mode("append").partitionBy("date").parquet(f"{self.base}/cluster_items")

    def set_cluster_texts(self, day, rows: DataFrame) -> None:
        """Sets those of title, summary, persona and why_matters that the rows (id, ...) have, and example_urls unless null."""
        old, names = self._day("clusters", day), [n for n in ("title", "summary", "persona", "why_matters") if n in rows.columns]
        urls = F.col("example_urls") if "example_urls" in rows.columns else F.lit(None)
        new = rows.select("id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in names], urls.alias("_urls"))
        joined = old.join(new, "id", "left")
        changed = {n: F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names} | {"example_urls": F.coalesce(F.col("_urls").cast("array<string>"), "example_urls")}
        self._replace("clusters", work.kept(joined.withColumns(changed)))

    def put_catalysts(self, rows: DataFrame, day=None) -> None:
        """Replaces the days of catalysts; their order is ``ordinal``.  Without rows ``day`` is left without catalysts."""
        rows = work.kept(rows)
        if rows.limit(1).count():
            self._replace("catalysts", rows)
        elif day is not None:
            self.delete_day("catalysts", day)

    def put_report(self, rows: DataFrame, markdown_path: str | None = None) -> None:
        """Replaces the reports (date, markdown) of their days, and writes one markdown file if a path is given."""
        self._replace("reports", rows)
        if markdown_path:
            store.write_report(rows, markdown_path)

    def delete_day(self, name: str, day) -> None:
        """Removes a day of a daily table; members go with their clusters."""
        for table in (name, "cluster_items") if name == "clusters" else (name,):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}/date={day}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def seed(self, interests: DataFrame, sources: DataFrame) -> None:
        """Upserts interests by name and their sources (interest, source_type, source_value, weight); sources of unknown interests are skipped."""
        named = interests.withColumn("id", F.sha2("name", 256))
        self._upsert("interests", named, {"id": "old"})
        known = self.read("interests").select(F.col("id").alias("interest_id"), F.col("name").alias("interest"))
        self._upsert("interest_sources", sources.join(known, "interest").dropDuplicates(["interest_id", "source_type", "source_value"]), {})

    # ---- scans

    def items_of(self, day) -> DataFrame:
        """Items fetched on a day, newest first."""
        return self.keyed("raw_items").read([str(day)]).drop("day").orderBy(F.desc_nulls_last("published_at"), "id")

    def labels_of(self, ids: DataFrame) -> DataFrame:
        """Labels of the ids (id): scores as doubles, null where unknown; confidence and pain score 0, lists empty instead of null."""
        rows = self.keyed("item_labels").of_keys(ids.select(F.col("id").alias("raw_item_id")))
        zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        plain = {c: F.col(c).cast("double") for c in ("audience_fit", "pain_intensity", "actionability")}
        lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("evidence_spans", "topic_tags", "claim_anchors")}
        return rows.withColumns(plain | lists | {"confidence": zero("confidence"), "pain_score": zero("pain_score")})

    def embeddings_of(self, ids: DataFrame) -> DataFrame:
        return self.keyed("embeddings").of_keys(ids.select(F.col("id").alias("raw_item_id")))

    def _day(self, name: str, day) -> DataFrame:
        return self.read(name).where(F.col("date") == F.lit(day).cast("date"))

    def clusters_of(self, day) -> DataFrame:
        return self._day("clusters", day).orderBy("cluster_index")

    def previous_clusters(self, day) -> DataFrame:
        """Clusters of the day before, best first."""
        return self.read("clusters").where(F.col("date") == F.date_sub(F.lit(day).cast("date"), 1)).orderBy(F.desc("score"), "id")

    def cluster_members(self, day) -> DataFrame:
        """Items of a day's clusters with cluster_id and cluster_index, in order of cluster, then newest first."""
        c = self._day("clusters", day).select(F.col("id").alias("cluster_id"), "cluster_index")
        m = self._day("cluster_items", day).select("cluster_id", F.col("raw_item_id").alias("id"))
        return c.join(m, "cluster_id").join(self.keyed("raw_items").of_keys(m.select("id")), "id").orderBy("cluster_index", F.desc_nulls_last("published_at"), "id")

    def catalysts_of(self, day) -> DataFrame:
        return self._day("catalysts", day).orderBy("ordinal", "id")

    def report_of(self, day) -> DataFrame:
        return self._day("reports", day).select("markdown")

    def source_list(self) -> DataFrame:
        """Sources with the name of their interest."""
        i = self.read("interests").select(F.col("id").alias("interest_id"), F.col("name").alias("interest"))
        return self.read("interest_sources").join(i, "interest_id").orderBy("source_type", "source_value", "interest")

    def report_status(self, day: str) -> tuple[int, object]:
        """(status, parsed report): 400 for no date, 404 for no report, 422 for one that cannot be read, else 200."""
        from ..functions.render import parse_report
        from ..functions.text import is_day

        spark_day = self.spark.range(1).select(is_day(F.lit(day)).alias("ok")).first()["ok"]
        if not spark_day:
            return 400, None
        row = self._day("reports", day).select("markdown", parse_report(F.col("markdown")).alias("issue")).first()
        if row is None or not row["markdown"]:
            return 404, None
        return (200, row["issue"]) if row["issue"] is not None else (422, None)

    def state_of(self, day) -> DataFrame:
        """(what, n, detail): what is stored of a day: items, clusters, catalysts, and the length of the report."""
        part = lambda df, what, detail: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.coalesce(detail, F.lit("")).alias("detail"))
        names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_index", "title", "size"))), lambda c: F.concat(F.coalesce(c["title"], F.lit("")), F.lit(" ("), F.coalesce(c["size"].cast("string"), F.lit("?")), F.lit(")"))), "; ")
        titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title"))), lambda c: F.coalesce(c["title"], F.lit(""))), "; ")
        return (
            part(self.items_of(day), "items", F.lit(None).cast("string")).unionByName(part(self._day("clusters", day), "clusters", names)).unionByName(part(self._day("catalysts", day), "catalysts", titles))
            .unionByName(part(self._day("reports", day), "reports", F.max(F.substring("markdown", 1, 2000))))
        )


# Interests with a description, and sources by interest with a weight.
INTERESTS = [
    ("General", "Broad tech and product signals"), ("Developer Tools", "IDEs, CLIs, dev experience, debugging"), ("AI / ML", "Machine learning, LLMs, AI products"), ("SaaS & B2B", "B2B software, enterprise, pricing"),
    ("Startups", "Founder pain, fundraising, growth"), ("Design & UX", "Design systems, user research, accessibility"), ("Data & Infra", "Databases, data pipelines, infrastructure"),
    ("Security & Compliance", "Security, privacy, compliance"), ("Marketing", "Growth, SEO, content, ads"), ("Mobile", "iOS, Android, cross-platform"),
]
SOURCES = [
    ("General", "subreddit", "technology", 1.0), ("General", "rss", "https://news.ycombinator.com/rss", 1.0), ("Developer Tools", "subreddit", "programming", 1.0), ("Developer Tools", "subreddit", "vscode", 1.0),
    ("Developer Tools", "subreddit", "devops", 1.0), ("Developer Tools", "rss", "https://blog.jetbrains.com/feed/", 0.8), ("AI / ML", "subreddit", "MachineLearning", 1.0), ("AI / ML", "subreddit", "LocalLLaMA", 1.0),
    ("AI / ML", "rss", "https://blog.google/technology/developers/feed/", 0.9), ("SaaS & B2B", "subreddit", "SaaS", 1.0), ("SaaS & B2B", "subreddit", "startups", 0.9), ("SaaS & B2B", "rss", "https://www.saastr.com/feed/", 0.8),
    ("Startups", "subreddit", "startups", 1.0), ("Startups", "subreddit", "entrepreneur", 0.9), ("Startups", "rss", "https://www.ycombinator.com/blog/feed/", 0.9), ("Design & UX", "subreddit", "UXDesign", 1.0),
    ("Design & UX", "subreddit", "userexperience", 1.0), ("Data & Infra", "subreddit", "dataengineering", 1.0), ("Data & Infra", "subreddit", "aws", 0.9), ("Data & Infra", "rss", "https://aws.amazon.com/blogs/aws/feed/", 0.8),
    ("Security & Compliance", "subreddit", "netsec", 1.0), ("Security & Compliance", "subreddit", "cybersecurity", 1.0), ("Marketing", "subreddit", "SEO", 1.0), ("Marketing", "subreddit", "marketing", 1.0),
    ("Mobile", "subreddit", "iOSProgramming", 1.0), ("Mobile", "subreddit", "androiddev", 1.0),
]


def seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(INTERESTS, "name string, description string"), spark.createDataFrame(SOURCES, "interest string, source_type string, source_value string, weight double")
