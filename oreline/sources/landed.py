"""Sources over landed files: readers, field mappers, ranking of posts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import comment_score
from ..functions.text import nz, strip
from ..operators.relational import first_per_key, top_per_key

RAW_ITEM = (
    "id string, source string, source_id string, url string, title string, text string, author string, published_at timestamp, fetched_at timestamp, "
    "metadata struct<score: bigint, descendants: bigint, subreddit: string, via: string, feed_url: string, comments: array<struct<post_id: string, comment_id: string, author: string, created_at: string, text: string, post_url: string, comment_url: string>>>, evidence_snippets array<string>"
)
LABEL = "raw_item_id string, label string, confidence decimal(4,3), pain_score decimal(5,2), audience_fit decimal(4,3), pain_intensity decimal(4,3), actionability decimal(4,3), evidence_spans array<string>, topic_tags array<string>, claim_anchors array<string>, exclude_reason string"
CLUSTER = "id string, date date, cluster_index int, title string, summary string, persona string, why_matters string, size int, score decimal(6,2), top_terms array<string>, example_urls array<string>"
CATALYST = "id string, date date, title string, summary string, interests array<string>, problems_created string, source_urls array<string>, what_changed string, who_feels_it string, opportunity_wedge string, confidence decimal(4,3)"
# Addresses of posts and threads.
POST_URL, THREAD_HOST = "https://news.ycombinator.com/item?id=", "https://www.reddit.com"


def read_landed(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Landed JSON, Parquet, ORC or CSV with a declared schema, never inferred."""
    reader = spark.read.schema(schema)
    return reader.option("multiLine", True).json(path) if kind == "json" else reader.format(kind).load(path)


def item_id(source: Column, source_id: Column) -> Column:
    """The same id in every run."""
    return F.sha2(F.concat_ws("\u0001", source, source_id), 256)


def parse_time(c: Column) -> Column:
    """Epoch seconds or an ISO time; null if neither."""
    return F.coalesce(F.timestamp_seconds(c.try_cast("double")), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))


def _mail_time(c: Column) -> Column:
    """A time as mails and feeds write it, such as Sat, 03 Feb 2024 04:00:00 GMT; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), r"(GMT|UTC?)$", "+0000")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))


def absolute_url(c: Column) -> Column:
    path = F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit("/"), c))
    return F.when(F.coalesce(c, F.lit("")) == "", c).when(~F.startswith(c, F.lit("http")), F.concat(F.lit(THREAD_HOST), path)).otherwise(c)


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the named columns, where it is there and not empty."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def map_thread_item(df: DataFrame) -> DataFrame:
    """(source_id, url, title, text) of posts with alternative field names; the id falls back to a hash of the address."""
    url = absolute_url(_first(df, "url", "link", "permalink"))
    return df.select(F.coalesce(_first(df, "id", "postId", "hash"), F.xxhash64(url).cast("string")).alias("source_id"), url.alias("url"), nz(F.col("title"), "").alias("title"), nz(_first(df, "body", "text", "selftext", "content"), "").alias("text"))


#: What every source gives; metadata holds what only some have.
ITEM = ("source", "source_id", "url", "title", "text", "author", "published_at", "metadata")


def _metadata(**known: Column) -> Column:
    """The metadata struct of RAW_ITEM, null where nothing is known."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(RAW_ITEM)["metadata"].dataType.fields
    return F.struct(*[(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _post_url(post: Column) -> Column:
    return F.concat(F.lit(POST_URL), post.cast("string"))


def story_candidates(feeds: list[DataFrame], posts: DataFrame, n: int = 25) -> DataFrame:
    """Stories among the first max(2 n, 60) ids of each feed (ordinal, id), once each."""
    most = max(2 * n, 60)
    ids = None
    for feed in feeds:
        first = feed.orderBy("ordinal").limit(most).select("id")
        ids = first if ids is None else ids.unionByName(first)
    return posts.where("type = 'story'").join(F.broadcast(ids.distinct()), "id", "left_semi")  # at most ``most`` ids a feed


def rank_stories(stories: DataFrame, n: int = 25) -> DataFrame:
    """The n stories with most comments, then the highest score."""
    return stories.orderBy(F.desc(F.coalesce("descendants", F.lit(0))), F.desc(F.coalesce("score", F.lit(0))), "id").limit(n)


def story_comments(stories: DataFrame, comments: DataFrame, n: int = 30, lexicon: list[str] | None = None) -> DataFrame:
    """(post_id, comments): of the first max(n + 20, 50) kids of each story the n best, best first, with their addresses."""
    kids = stories.select(F.col("id").alias("post_id"), F.posexplode(F.slice("kids", 1, max(n + 20, 50))).alias("ordinal", "id"))
    both = kids.join(comments.where("type = 'comment'").select("id", "by", "time", strip(F.col("text")).alias("text")), "id")
    best = top_comments(both, "post_id", "text", "ordinal", n, lexicon)
    one = F.struct(
        F.col("rank"), F.col("post_id").cast("string").alias("post_id"), F.col("id").cast("string").alias("comment_id"), F.col("by").alias("author"),
        F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.col("text"), _post_url(F.col("post_id")).alias("post_url"), _post_url(F.col("id")).alias("comment_url"),
    )
    sorted_ = F.array_sort(F.collect_list(one))
    return best.groupBy("post_id").agg(F.transform(sorted_, lambda c: F.struct(*[c[k].alias(k) for k in ("post_id", "comment_id", "author", "created_at", "text", "post_url", "comment_url")])).alias("comments"))


def story_items(stories: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Stories, with their comments (post_id, comments), as items."""
    df = stories if comments is None else stories.join(comments.withColumnRenamed("post_id", "id"), "id", "left")
    known = {"score": F.col("score"), "descendants": F.col("descendants")} | ({} if comments is None else {"comments": F.col("comments")})
    title = nz(F.col("title"), "")
    text = F.when(nz(F.col("text"), "") != "", F.concat(title, F.lit("\n\n"), F.col("text"))).otherwise(title)
    return df.select(
        F.lit("hn").alias("source"), F.col("id").cast("string").alias("source_id"), nz(F.col("url"), _post_url(F.col("id"))).alias("url"), F.substring(title, 1, 500).alias("title"), F.substring(text, 1, 50_000).alias("text"),
        F.col("by").alias("author"), F.timestamp_seconds("time").alias("published_at"), _metadata(**known).alias("metadata"),
    )


def scraped_items(df: DataFrame) -> DataFrame:
    """Scraped posts (ordinal, subreddit, and fields under alternative names) as items, once per id in their order; comments without a title are left out."""
    title = F.substring(nz(_first(df, "title", "headline"), ""), 1, 500)
    body = nz(_first(df, "body", "text", "selftext", "content"), "")
    url = absolute_url(_first(df, "url", "link", "permalink"))
    made = F.xxhash64(nz(url, ""), title, F.col("subreddit")).cast("string")
    name = F.regexp_replace(F.concat(F.col("subreddit"), F.lit("_"), F.coalesce(_first(df, "id", "postId"), made)), "^_+|_+$", "")
    kind = F.coalesce(F.col("type") == "comment", F.lit(False)) if "type" in df.columns else F.lit(False)
    rows = df.where(~(kind & (nz(_first(df, "title"), "") == ""))).select(
        "ordinal", F.lit("reddit").alias("source"), name.alias("source_id"), F.substring(nz(url, ""), 1, 2000).alias("url"), title.alias("title"), F.substring(F.when(body != "", F.concat(title, F.lit("\n\n"), body)).otherwise(title), 1, 50_000).alias("text"),
        _first(df, "author", "username").alias("author"), parse_time(_first(df, "createdAt", "created_utc", "timestamp")).alias("published_at"),
        _metadata(subreddit=F.col("subreddit"), score=F.coalesce(_first(df, "score", "upvotes").try_cast("long"), F.lit(0)), via=F.lit("scrape")).alias("metadata"),
    )
    return first_per_key(rows, ["source_id"], [F.col("ordinal")]).select(*ITEM)


def listing_items(listings: DataFrame, n: int = 25) -> DataFrame:
    """Posts of several listings (subreddit, listing, ordinal, ...) as items: the first n // 3 + 1 of each, repeats and all; the upsert keeps one."""
    rows = top_per_key(listings, ["subreddit", "listing"], [F.col("ordinal")], n // 3 + 1)
    title = nz(F.col("title"), "")
    return rows.select(
        F.lit("reddit").alias("source"), F.concat(F.col("subreddit"), F.lit("_"), F.col("id")).alias("source_id"), F.when(nz(F.col("permalink"), "") != "", absolute_url(F.col("permalink"))).alias("url"), F.substring(title, 1, 500).alias("title"),
        F.substring(F.concat(title, F.lit("\n\n"), nz(F.col("selftext"), "")), 1, 50_000).alias("text"), F.col("author"), F.timestamp_seconds("created_utc").alias("published_at"), _metadata(subreddit=F.col("subreddit"), score=F.coalesce("score", F.lit(0))).alias("metadata"),
    )


def feed_items(entries: DataFrame, n: int = 20) -> DataFrame:
    """The first n entries of each feed (feed_url, ordinal, ...) as items, with the fallbacks of their fields; rows with an error are left out."""
    if "error" in entries.columns:
        entries = entries.where("error IS NULL")
    rows = newest_entries(entries, n=n)
    title, link = nz(_first(rows, "title"), ""), nz(_first(rows, "link"), "")
    summary = nz(_first(rows, "summary", "description"), "")
    name = F.coalesce(_first(rows, "id", "guid"), F.nullif(link, F.lit("")), F.concat(F.col("feed_url"), F.lit("_"), F.pmod(F.xxhash64(title, link), F.lit(1 << 31)).cast("string")))
    time = F.coalesce(*[F.coalesce(parse_time(_first(rows, c)), _mail_time(_first(rows, c))) for c in ("published", "pubDate", "updated")])
    return rows.select(
        F.lit("rss").alias("source"), F.substring(name, 1, 500).alias("source_id"), F.nullif(F.substring(link, 1, 2000), F.lit("")).alias("url"), F.substring(title, 1, 500).alias("title"),
        F.substring(F.concat(title, F.lit("\n\n"), summary), 1, 50_000).alias("text"), _first(rows, "author").alias("author"), time.alias("published_at"), _metadata(feed_url=F.col("feed_url")).alias("metadata"),
    )


def ingest(day, stories: DataFrame | None = None, scraped: DataFrame | None = None, listings: DataFrame | None = None, feeds: DataFrame | None = None) -> DataFrame:
    """All sources together, fetched on one day.  Scraped posts take the place of listings where there are any sources of both; a source that is not given is left out."""
    given = [df for df in (stories, scraped if scraped is not None else listings, feeds) if df is not None]
    rows = given[0]
    for df in given[1:]:
        rows = rows.unionByName(df)
    return rows.withColumns({"id": item_id(F.col("source"), F.col("source_id")), "fetched_at": F.lit(day).cast("timestamp")})


def top_stories(posts: DataFrame, n: int = 25) -> DataFrame:
    """Stories once each, by comments, then score."""
    once = first_per_key(posts.where("type = 'story'"), ["id"], [F.col("ordinal")])
    return once.orderBy(F.desc(F.coalesce("descendants", F.lit(0))), F.desc(F.coalesce("score", F.lit(0))), "id").limit(n)


def top_comments(comments: DataFrame, post: str, text: str, tie: str, n: int = 30, lexicon: list[str] | None = None) -> DataFrame:
    """The first n comments of each post by lexicon score, then length; texts are cut to 2000 characters as landed."""
    body = F.substring(text, 1, 2000)
    scored = comments.withColumn(text, body).where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("score", comment_score(F.col(text), *([lexicon] if lexicon else [])))
    return top_per_key(scored, [post], [F.desc("score"), F.desc(F.length(text)), F.col(tie)], n)


def newest_entries(entries: DataFrame, feed: str = "feed_url", n: int = 20) -> DataFrame:
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy("ordinal"))).where(F.col("_n") <= n).drop("_n")


def subscribers(rows: DataFrame, email: str = "email") -> DataFrame:
    """Mail addresses, trimmed, in lower case, once each; what is no address is left out."""
    clean = rows.select(F.lower(F.trim(email)).alias("email"))
    return clean.where(F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")).distinct()
