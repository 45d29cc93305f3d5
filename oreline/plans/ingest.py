"""Queries of sources: stories with comments, scraped posts, listings, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..sources import landed
from . import views
from .registry import n_contained, query, strip
from .views import said, said_sql

# ---- stories and comments: conversations as posts, their turns as comments

_TURNS = f"turns AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, role, text || ' ' || {said_sql('conv_id + turn')} AS text FROM conversations)"
_STORIES = """stories AS (SELECT conv_id AS id, count(*) AS descendants, conv_id % 50 AS score, CASE WHEN conv_id % 7 = 3 THEN 'job' ELSE 'story' END AS type, list(id ORDER BY turn) AS kids FROM turns GROUP BY 1),
 fed AS (SELECT id FROM (SELECT id FROM stories ORDER BY id DESC LIMIT 60) UNION SELECT id FROM (SELECT id FROM stories ORDER BY id * 7919 % 1009, id LIMIT 60))"""


def _turns(spark, sf):
    c = views.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.concat("text", F.lit(" "), said(F.col("conv_id") + F.col("turn"))).alias("text"))


def _stories(spark, sf):
    k = F.col("id")
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"])
    posts = _turns(spark, sf).groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("descendants"), sorted_.alias("kids"))
    posts = posts.withColumns({
        "score": k % 50, "type": F.when(k % 7 == 3, "job").otherwise("story"), "title": F.concat(F.lit("Story "), k.cast("string")), "url": F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("http://s/"), k.cast("string"))),
        "text": F.when(k % 2 == 0, "body"), "by": F.lit("a"), "time": k + 1_700_000_000,
    })
    feeds = [posts.select("id", (-k).alias("ordinal")), posts.select("id", (k * 7919 % 1009 * 10**9 + k).alias("ordinal"))]
    return landed.rank_stories(landed.story_candidates(feeds, posts))


@query(
    f"WITH {_TURNS}, {_STORIES}, top AS (SELECT * FROM stories WHERE type = 'story' AND id IN (SELECT id FROM fed) ORDER BY descendants DESC, score DESC, id LIMIT 25)," + rf"""
 kid AS (SELECT top.id AS post, o, t.id, substring({strip('t.text')}, 1, 2000) AS text FROM (SELECT id, unnest(kids[1:50]) AS kid, generate_subscripts(kids[1:50], 1) AS o FROM top) top JOIN turns t ON t.id = kid),
 best AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY {n_contained('text', lexicons.COMMENT_WORDS)} DESC, length(text) DESC, o) AS r FROM kid WHERE text <> '')
 SELECT top.id::VARCHAR AS source_id, CASE WHEN top.id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || top.id ELSE 'http://s/' || top.id END AS url, 'Story ' || top.id || CASE WHEN top.id % 2 = 0 THEN chr(10) || chr(10) || 'body' ELSE '' END AS text,
  (SELECT string_agg(id::VARCHAR, ',' ORDER BY r) FROM best WHERE post = top.id AND r <= 30) AS comments, (SELECT 'https://news.ycombinator.com/item?id=' || min(id) FILTER (r = 1) FROM best WHERE post = top.id) AS first_url FROM top"""
)
def story_items(spark, sf):
    """Stories of two feeds with their best comments, as items."""
    stories = _stories(spark, sf)
    comments = landed.story_comments(stories, _turns(spark, sf).select("id", F.lit("comment").alias("type"), F.col("role").alias("by"), F.col("id").alias("time"), "text"))
    out = landed.story_items(stories, comments)
    shown = F.array_join(F.transform("metadata.comments", lambda c: c["comment_id"]), ",")
    return out.select("source_id", "url", "text", shown.alias("comments"), F.get("metadata.comments", F.lit(0))["comment_url"].alias("first_url"))


# ---- scraped posts, listings and feeds: parts and orders under the field names of each

_PAGE = "CASE p_partkey % 4 WHEN 0 THEN 'https://h/' || p_partkey WHEN 1 THEN 'https://www.reddit.com/r/' || p_partkey WHEN 2 THEN 'https://www.reddit.com/rel/' || p_partkey ELSE '' END"


@query(f"""SELECT 'reddit' AS source, p_brand || '_' || p_partkey // 3 AS source_id, {_PAGE} AS url, p_name AS title, p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END AS text, CASE WHEN p_partkey % 5 = 0 THEN 1700000000 + p_partkey WHEN p_partkey % 5 = 1 THEN 1706932800 + p_partkey % 60 END::BIGINT AS epoch
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey // 3 ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 11 <> 0) WHERE r = 1""")
def scraped_items(spark, sf):
    """Posts under alternative field names; each third brand and number repeats an id, comments without a title go."""
    k, num = F.col("p_partkey"), F.col("p_partkey").cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://h/"), num)).otherwise(F.lit(""))
    link = F.when(k % 4 == 1, F.concat(F.lit("/r/"), num))
    relative = F.when(k % 4 == 2, F.concat(F.lit("rel/"), num))
    made = F.when(k % 5 == 0, (k + 1_700_000_000).cast("string")).when(k % 5 == 1, F.concat(F.lit("2024-02-03T04:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z"))).when(k % 5 == 2, "soon")
    rows = views.table(spark, sf, "part").select(
        k.alias("ordinal"), F.col("p_brand").alias("subreddit"), F.floor(k / 3).cast("string").alias("postId"), url.alias("url"), link.alias("link"), relative.alias("permalink"), F.when(k % 11 != 0, F.col("p_name")).alias("title"),
        F.when(k % 2 == 0, F.col("p_type")).alias("selftext"), F.when(k % 11 == 0, "comment").otherwise("post").alias("type"), made.alias("createdAt"),
    )
    out = landed.scraped_items(rows)
    return out.select("source", "source_id", "url", "title", "text", F.unix_timestamp("published_at").alias("epoch"))


@query("SELECT o_orderpriority || '_' || o_orderkey AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://www.reddit.com/r/' || o_orderkey END AS url, o_clerk || chr(10) || chr(10) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS r FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders)) WHERE r <= 9")
def listing_items(spark, sf):
    o, k = views.table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(
        F.col("o_orderpriority").alias("subreddit"), F.col("o_orderstatus").alias("listing"), k.alias("ordinal"), k.cast("string").alias("id"), F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(k % 3 != 0, F.concat(F.lit("/r/"), k.cast("string"))).alias("permalink"), F.lit(None).cast("string").alias("selftext"), F.lit("a").alias("author"), k.alias("created_utc"), F.lit(1).alias("score"),
    )
    return landed.listing_items(rows).select("source_id", "url", "text")


@query("""SELECT feed, CASE WHEN k % 3 = 0 THEN 'g' || k WHEN k % 5 <> 0 THEN 'http://l/' || k ELSE 'made' END AS source_id, CASE WHEN k % 5 <> 0 THEN 'http://l/' || k END AS url, n || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN t ELSE 'desc' END AS text, CASE WHEN k % 4 = 0 THEN 1706932800 + k % 60 WHEN k % 4 = 1 THEN 1706936400 + k % 60 END::BIGINT AS epoch
 FROM (SELECT p_brand AS feed, p_partkey AS k, p_name AS n, p_type AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 20""")
def feed_items(spark, sf):
    k, num = F.col("p_partkey"), F.col("p_partkey").cast("string")
    second = F.lpad((k % 60).cast("string"), 2, "0")
    rows = views.table(spark, sf, "part").select(
        F.col("p_brand").alias("feed_url"), k.alias("ordinal"), F.when(k % 3 == 0, F.concat(F.lit("g"), num)).alias("guid"), F.when(k % 5 != 0, F.concat(F.lit("http://l/"), num)).alias("link"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("summary"),
        F.lit("desc").alias("description"), F.when(k % 4 == 0, F.concat(F.lit("Sat, 03 Feb 2024 04:00:"), second, F.lit(" +0000"))).alias("pubDate"), F.when(k % 4 == 1, F.concat(F.lit("2024-02-03T05:00:"), second, F.lit("Z"))).alias("updated"),
    )
    out = landed.feed_items(rows)
    made = F.startswith("source_id", F.concat("metadata.feed_url", F.lit("_")))
    return out.select(F.col("metadata.feed_url").alias("feed"), F.when(made, "made").otherwise(F.col("source_id")).alias("source_id"), "url", "text", F.unix_timestamp("published_at").alias("epoch"))


@query(f"""WITH {_TURNS}, {_STORIES}, n AS (SELECT 'hn' AS source, least(25, count(*)) AS n FROM stories WHERE type = 'story' AND id IN (SELECT id FROM fed) UNION ALL SELECT 'reddit', count(*) FROM (SELECT row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 9
 UNION ALL SELECT 'rss', count(*) FROM (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 20) SELECT source, n, n AS n_ids, '2024-02-03' AS day FROM n""")
def ingest_counts(spark, sf):
    """Rows and different ids of each source on a day, all sources together; listings stand in where nothing was scraped."""
    o, p, k = views.table(spark, sf, "orders"), views.table(spark, sf, "part"), F.col("o_orderkey")
    listings = o.select(F.col("o_orderpriority").alias("subreddit"), F.col("o_orderstatus").alias("listing"), k.alias("ordinal"), k.cast("string").alias("id"), F.lit("t").alias("title"), F.lit("").alias("permalink"), F.lit("").alias("selftext"), F.lit("a").alias("author"), k.alias("created_utc"), F.lit(1).alias("score"))
    feeds = p.select(F.col("p_brand").alias("feed_url"), F.col("p_partkey").alias("ordinal"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    rows = landed.ingest("2024-02-03", landed.story_items(_stories(spark, sf)), None, landed.listing_items(listings), landed.feed_items(feeds))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.max(F.to_date("fetched_at")).cast("string").alias("day"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1700000000 + event_id WHEN 1 THEN 1706918400 + (event_id % 24) * 3600 + event_id % 60 END::BIGINT AS epoch FROM events")
def polymorphic_ts(spark, sf):
    k = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    t = F.when(k % 4 == 0, (k + 1_700_000_000).cast("string")).when(k % 4 == 1, F.concat(F.lit("2024-02-03T"), two(k % 24), F.lit(":00:"), two(k % 60), F.lit("Z"))).when(k % 4 == 2, "soon")
    return views.table(spark, sf, "events").select("event_id", F.unix_timestamp(landed.parse_time(t)).alias("epoch"))


@query("SELECT DISTINCT lower(m) AS email FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'A' || c_custkey % 50 || '@B.com' WHEN 1 THEN 'a' || c_custkey % 50 || '@b.com' END AS m FROM customer) WHERE m IS NOT NULL")
def email_clean(spark, sf):
    """Addresses of subscribers, trimmed, in lower case, once each; what is no address goes."""
    k = F.col("c_custkey")
    num = (k % 50).cast("string")
    m = F.when(k % 4 == 0, F.concat(F.lit(" A"), num, F.lit("@B.com "))).when(k % 4 == 1, F.concat(F.lit("a"), num, F.lit("@b.com"))).when(k % 4 == 2, F.concat(F.lit("a"), num, F.lit("@b")))
    return landed.subscribers(views.table(spark, sf, "customer").select(m.alias("email")))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS is_day FROM orders")
def day_check(spark, sf):
    from ..functions.text import is_day

    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 3 == 1, F.concat(F.lit("2024-13-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).otherwise("2024-2-3")
    return views.table(spark, sf, "orders").select("o_orderkey", is_day(written).alias("is_day"))
