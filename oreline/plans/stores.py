"""Queries that go through the engine's stores: items by day, labels by id, the ledger of answers, coherence of whole clusters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import lexicons, text
from ..operators import greedy, report, rewrite, work
from ..operators.tables import Tables
from ..sources import feeds, landed
from ..sources.ledger import Ledger
from . import views
from .cards import _C, _DRAFT_COLS, _P, _VALID, _drafts, _plain
from .registry import literal, n_contained, query, strip
from .views import ITEMS, LABELS, posts

# ---- tables


def _stored(spark, sf) -> Tables:
    """All documents as items of the day they are from, then those with a label fetched anew on one later day."""
    t = Tables(spark, work.new_folder(spark, "tables"))
    d = views.items(spark, sf).select("source", F.col("id").cast("string").alias("source_id"), "url", "title", "text", F.col("published_at").cast("timestamp").alias("published_at"))
    t.put_items(d.withColumn("fetched_at", F.col("published_at")))
    labelled = views.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_id")).distinct()
    again = d.join(labelled, "source_id", "left_semi").withColumns({"url": F.lit("http://new"), "title": F.concat(F.lit("again "), "title"), "fetched_at": F.lit("2024-03-01").cast("timestamp")})
    t.put_items(again)
    return t


_STORED = f"""WITH {ITEMS}, again AS (SELECT DISTINCT doc_id AS id FROM labels),
 stored AS (SELECT i.id, i.source, i.url, CASE WHEN a.id IS NULL THEN i.title ELSE 'again ' || i.title END AS title, i.published_at, CASE WHEN a.id IS NULL THEN i.published_at ELSE DATE '2024-03-01' END AS day FROM v_items i LEFT JOIN again a USING (id))
"""


@query(_STORED + "SELECT id::VARCHAR AS source_id, source, url, title, coalesce(day::VARCHAR, 'none') AS day FROM stored")
def stored_items(spark, sf):
    """Every item after two upserts: its first address stays, its title and day are the last."""
    return _stored(spark, sf).keyed("raw_items").read().select("source_id", "source", "url", "title", "day")


@query(_STORED + "SELECT id::VARCHAR AS source_id, title FROM stored WHERE day = '2024-03-01'")
def items_of_day(spark, sf):
    return _stored(spark, sf).items_of("2024-03-01").select("source_id", "title")


@query(
    _STORED.replace("WITH ", f"WITH {LABELS}, ", 1) + """SELECT id::VARCHAR AS source_id, label, round(confidence::DOUBLE, 6) AS confidence, round(coalesce(audience_fit, 0)::DOUBLE, 6) AS audience_fit
 FROM stored JOIN v_labels USING (id) WHERE day = '2024-03-01'"""
)
def labels_of_day(spark, sf):
    """Labels by the ids of a day's items, through the key index; a null score in a second write keeps the first."""
    t = _stored(spark, sf)
    ids = t.read("raw_items").select(F.col("id").alias("raw_item_id"), F.col("source_id").cast("long").alias("id"))
    rows = ids.join(views.labels(spark, sf), "id").drop("id")
    t.put_labels(rows, "2024-01-01")
    t.put_labels(rows.withColumn("audience_fit", F.lit(None).cast("decimal(4,3)")), "2024-01-02")
    day = t.items_of("2024-03-01")
    got = t.labels_of(day).join(day.select(F.col("id").alias("raw_item_id"), "source_id"), "raw_item_id")
    return got.select("source_id", "label", F.round("confidence", 6).alias("confidence"), F.round(F.coalesce("audience_fit", F.lit(0.0)), 6).alias("audience_fit"))


@query("SELECT vec_id::VARCHAR AS raw_item_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def vectors_by_key(spark, sf):
    """All vectors stored, and those of labelled ids looked up through the key index."""
    t = Tables(spark, work.new_folder(spark, "tables"))
    t.put_embeddings(views.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("raw_item_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("given").alias("model")), "2024-01-01")
    found = t.embeddings_of(views.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")))
    return found.select("raw_item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT 'rss' AS source_type, s_name AS source_value, n_name AS interest, (s_suppkey % 3 * 0.5)::DOUBLE AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def seeded_sources(spark, sf):
    """Nations as interests and suppliers as their sources, seeded twice; sources of an unknown interest are skipped."""
    t = Tables(spark, work.new_folder(spark, "tables"))
    nation, supplier = views.table(spark, sf, "nation"), views.table(spark, sf, "supplier")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("interest"), F.lit("rss").alias("source_type"), F.col("s_name").alias("source_value"), (F.col("s_suppkey") % 3 * 0.5).alias("weight"))
    interests = nation.select(F.col("n_name").alias("name"), F.lit("old").alias("description"))
    t.seed(interests, rows.withColumn("weight", F.lit(1.0)).unionByName(rows.withColumn("interest", F.lit("nobody"))))
    t.seed(interests.withColumn("description", F.lit("new")), rows)
    return t.source_list().select("source_type", "source_value", "interest", "weight")


_DAYS = f"WITH {ITEMS}, c AS (SELECT published_at AS date, cluster, count(*) AS size FROM v_items WHERE published_at IS NOT NULL GROUP BY ALL)\n"


def _clustered(spark, sf) -> Tables:
    """Documents as items of their days, and their clusters and members."""
    t = Tables(spark, work.new_folder(spark, "tables"))
    d = views.items(spark, sf).where("published_at IS NOT NULL")
    t.put_items(d.select("source", F.col("id").cast("string").alias("source_id"), "url", "title", "text", F.col("published_at").cast("timestamp").alias("published_at"), F.col("published_at").cast("timestamp").alias("fetched_at")))
    rows = d.select(F.col("published_at").alias("date"), F.concat_ws("/", "published_at", "cluster").alias("cluster_id"), F.col("cluster").alias("cluster_index"), landed.item_id(F.col("source"), F.col("id").cast("string")).alias("raw_item_id"))
    clusters = rows.groupBy("date", F.col("cluster_id").alias("id"), "cluster_index").agg(F.count("*").cast("int").alias("size")).withColumns({"title": F.concat(F.lit("c"), "cluster_index"), "score": F.col("size") / 10})
    t.put_clusters(clusters, rows)
    return t


@query(_DAYS + "SELECT cluster AS cluster_index, size::INT AS size, 'c' || cluster AS title FROM c WHERE date = DATE '2024-01-15'")
def clusters_before(spark, sf):
    """The clusters of the day before."""
    return _clustered(spark, sf).previous_clusters("2024-01-16").select("cluster_index", "size", "title")


@query(_DAYS + "SELECT cluster AS cluster_index, id::VARCHAR AS source_id, title FROM v_items WHERE published_at = DATE '2024-01-15'")
def members_of_day(spark, sf):
    """The items of a day's clusters, looked up by their ids."""
    return _clustered(spark, sf).cluster_members("2024-01-15").select("cluster_index", "source_id", "title")


# ---- coherence over all snippets


@query(
    _P + f"""SELECT cluster, direct::BIGINT AS direct, hits::BIGINT AS hits, direct >= 1 OR hits >= 2 AS supported FROM (
 SELECT cluster, {n_contained("array_to_string(snips, ' ')", lexicons.DIRECT_INDICATORS)} AS direct, len(list_filter(snips, lambda s: len(list_filter(tags, lambda t: contains(lower(s), t))) > 0)) AS hits
 FROM (SELECT s.cluster, snips, list_filter(list_transform(tags, lambda t: lower({strip('t')})), lambda t: t <> '') AS tags
  FROM (SELECT id // 5 AS cluster, flatten(list(evidence_snippets ORDER BY id)) AS snips, flatten(list(topic_tags)) AS tags FROM v_posts GROUP BY 1) s WHERE len(snips) > 0))"""
)
def coherent_clusters(spark, sf):
    """The coherence test over all snippets and tags of every cluster of five posts."""
    p = posts(spark, sf).withColumn("cluster_id", F.floor(F.col("id") / 5))
    said = p.select("cluster_id", F.col("id").alias("ordinal"), F.posexplode("evidence_snippets").alias("place", "value"))
    tags = p.select("cluster_id", F.explode("topic_tags").alias("value"))
    return report.support(said, tags).select(F.col("cluster_id").cast("long").alias("cluster"), "direct", "hits", "supported")


# ---- the greedy choice over a table

_LONG = r"[\p{L}]{13,}"


@query(
    f"""WITH RECURSIVE src AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_LONG}')) AS keys FROM documents),
 g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS seen, NULL::BIGINT AS doc_id UNION ALL
  SELECT s.n, CASE WHEN list_has_any(g.seen, s.keys) THEN g.seen ELSE list_concat(g.seen, s.keys) END, CASE WHEN list_has_any(g.seen, s.keys) THEN NULL ELSE s.doc_id END FROM g JOIN src s ON s.n = g.n + 1)
 SELECT doc_id FROM g WHERE doc_id IS NOT NULL"""
)
def disjoint_documents(spark, sf):
    """Documents in order of their ids that share no long word with one kept before."""
    d = views.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_LONG), 0).alias("keys"))
    return greedy.keep_disjoint(d, "doc_id", "keys", tail=100).select("doc_id")


# ---- drafts rewritten in rounds


class ScriptedItems:
    """Answers by the kind that a prompt names: at once, after a repair, or never as asked."""

    def generate(self, asked: list[str]) -> list[str | None]:
        return [self._one(p) for p in asked]

    def _one(self, p: str) -> str:
        kind = re.search(r"Kind: case (\d)", p).group(1)
        good = f'{{"hook": "{_VALID}", "explanation": "It hurts.", "why_bullets": ["why"], "who": "Teams", "wedge": "Fix it", "evidence_snippets": ["flaky again"], "links": ["http://z", "http://b"], "strength_or_impact": "odd"}}'
        if kind == "0" or (kind == "1" and p.startswith("Your JSON breaks these rules: ")):
            return f"```json\n{good}\n```"
        return good.replace(_VALID, "too short") if kind in "12" else "no JSON"

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


@query(
    _C + f""", src AS (SELECT {_DRAFT_COLS} FROM v_cards), made AS ({_plain('src')}) SELECT id, CASE WHEN id % 4 < 2 THEN {literal(_VALID)} ELSE hook END AS hook, CASE WHEN id % 4 < 2 THEN 'http://b' ELSE 'http://a||http://b' END AS links, grade,
 ['first', 'repaired', 'template', 'template'][id % 4 + 1] AS made_by FROM made"""
)
def rewritten_items(spark, sf):
    """Drafts rewritten in rounds through a ledger: valid at once, repaired, or made of the draft."""
    rows = _drafts(spark, sf).withColumn("kind", F.concat(F.lit("case "), (F.col("id") % 4).cast("string")))
    out = rewrite.rewrite_items(rows, Ledger(spark, work.new_folder(spark, "ledger")), ScriptedItems)
    return out.select("id", "item.hook", F.array_join("item.links", "|").alias("links"), F.col("item.strength_or_impact").alias("grade"), "made_by")


# ---- feeds


_ENTRY_SQL = "SELECT 'rss' AS source, CASE WHEN doc_id % 3 = 0 THEN 'http://l/' || doc_id WHEN doc_id % 3 = 1 THEN 'urn:' || doc_id ELSE 'g' || doc_id END AS source_id, 'http://l/' || doc_id AS url, substring(t, 1, 500) AS title, substring(t || chr(10) || chr(10) || t, 1, 50000) AS text, 'http://f/' || source AS feed"


@query(_ENTRY_SQL + rf" FROM (SELECT doc_id, source, {strip('text')} AS t FROM documents) WHERE t <> ''")
def feed_files(spark, sf):
    """Every document as a feed of its source in RSS, with or without a guid, or in Atom; read as bytes."""
    k = F.col("doc_id").cast("string")
    t = text.strip(F.coalesce("text", F.lit("")))
    safe = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    feed = F.concat(F.lit("http://f/"), "source")
    rss = lambda more: F.concat(F.lit("<rss><channel><link>"), feed, F.lit("</link><item><title>"), safe, F.lit("</title><link>http://l/"), k, F.lit("</link>"), more, F.lit("<description>"), safe, F.lit("</description></item></channel></rss>"))
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><link rel="alternate" href="http://other"/><link rel="self" href="'), feed, F.lit('"/><entry><link rel="edit" href="http://edit"/><link href="http://l/'), k,
        F.lit('"/><id>urn:'), k, F.lit("</id><title>"), safe, F.lit("</title><summary>"), safe, F.lit("</summary></entry></feed>"),
    )
    content = F.when(F.col("doc_id") % 3 == 0, rss(F.lit(""))).when(F.col("doc_id") % 3 == 1, atom).otherwise(rss(F.concat(F.lit("<guid>g"), k, F.lit("</guid>"))))
    rows = views.table(spark, sf, "documents").where(t != "").select(F.concat(F.lit("file:/landed/"), k).alias("path"), content.alias("content"))
    entries = feeds.parse_feeds(rows)
    # each file holds one entry, so each is among the first of its feed
    items = landed.feed_items(entries.withColumn("own", F.col("feed_url")).withColumn("feed_url", F.concat("feed_url", F.lit("#"), F.coalesce("id", "link"))), 20)
    return items.select("source", "source_id", "url", "title", "text", F.substring_index("metadata.feed_url", "#", 1).alias("feed"))
