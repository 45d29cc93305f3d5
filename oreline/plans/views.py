"""Views of the engine's tables over the test tables, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_words, let, words
from .registry import first_words as sql_first_words
from .registry import literal
from .registry import words as sql_words


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "rss").when(F.col("source") == "src1", "hn").otherwise("reddit").alias("source"), F.substring("text", 1, 80).alias("title"), "text",
        F.concat(F.lit("http://x/"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("url"), F.when(F.col("doc_id") % 17 != 0, day).alias("published_at"), (F.col("doc_id") % 15).cast("int").alias("cluster"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all documents; the scores are null together for every 13th."""
    d = table(spark, sf, "documents").select("doc_id")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("exclude_reason"))
    part = lambda k: (F.col("doc_id") * k % 1000 / F.lit(1000.0)).cast("decimal(4,3)")
    some = lambda k: F.when(F.col("doc_id") % 13 != 0, part(k))
    label = F.element_at(F.array(*[F.lit(x) for x in ("PAIN", "DISCUSSION", "NEWS", "OTHER")]), (F.col("doc_id") % 4 + 1).cast("int"))
    spans = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("span")))
    return d.join(toxic, "doc_id", "left").select(F.col("doc_id").alias("id"), label.alias("label"), part(37).alias("confidence"), some(53).alias("audience_fit"), some(71).alias("pain_intensity"), some(89).alias("actionability"), spans.alias("evidence_spans"), "exclude_reason")


ITEMS = """v_items AS (SELECT doc_id AS id, CASE source WHEN 'src0' THEN 'rss' WHEN 'src1' THEN 'hn' ELSE 'reddit' END AS source, substring(text, 1, 80) AS title, text, 'http://x/' || (doc_id % 40)::VARCHAR AS url,
 CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + (doc_id % 30)::INT END AS published_at, (doc_id % 15)::INT AS cluster FROM documents)"""
LABELS = """v_labels AS (SELECT d.doc_id AS id, ['PAIN', 'DISCUSSION', 'NEWS', 'OTHER'][(d.doc_id % 4)::INT + 1] AS label, (d.doc_id * 37 % 1000 / 1000.0)::DECIMAL(4,3) AS confidence,
 CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id * 53 % 1000 / 1000.0)::DECIMAL(4,3) END AS audience_fit, CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id * 71 % 1000 / 1000.0)::DECIMAL(4,3) END AS pain_intensity,
 CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id * 89 % 1000 / 1000.0)::DECIMAL(4,3) END AS actionability, d.doc_id % 3 <> 0 AS has_spans, l.doc_id IS NOT NULL AS excluded
 FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id)"""


# ---- posts: documents with things that posts say, so that every rule has something to find

SAID = [
    "I wish it had", "why can't we", "how do I", "does anyone else see", "hate when it", "so frustrated", "annoying stuff", "struggling here", "problem with it", "issue with it", "a buggy build", "broken again", "this sucks", "terrible idea",
    "the worst part", "unusable today", "please add this", "is there an easy way", "any recommendations", "an alternative to it", "looking for one", "I need to ship", "want to leave", "would love to see", "hoping for more", "feature request",
    "all is well", "we had to stop", "this broke in production", "on-call incident", "cannot log in", "billing failed", "security exploit", "xss found", "source code", "prompt injection", "the deadline", "nothing here",
]


def said(k, n: int = 0):
    """One of SAID that a number decides."""
    return F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.pmod(k * 7 + n, F.lit(len(SAID))) + 1).cast("int"))


def said_sql(k: str, n: int = 0) -> str:
    return f"{literal(SAID)}[(({k}) * 7 + {n}) % {len(SAID)} + 1]"


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, source, source_id, url, cluster, title, text, evidence_snippets, comments, topic_tags, published_at)."""
    i, k = items(spark, sf), F.col("id")
    title = F.when(k % 23 == 0, "").otherwise(F.concat(said(k, 1), F.lit(" "), F.substring("text", 1, 60)))
    text = F.when(k % 19 == 0, "").otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(". "), said(k, 2), F.lit(" now. And "), said(k, 3), F.lit("? ")))
    heads = F.when(k % 3 < 2, F.array(first_words(F.col("text"), 5), said(k, 2), first_words(F.col("text"), 14))).otherwise(F.array().cast("array<string>"))
    one = lambda n, t, post: F.struct(t.alias("text"), post.alias("post_url"), F.concat(F.lit(f"c{n}-"), k.cast("string")).alias("comment_id"), F.concat(F.lit(f"http://c{n}/"), k.cast("string")).alias("comment_url"))
    comments = F.array(one(1, F.concat(F.lit("yes "), said(k, 2), F.lit(" today")), F.lit("http://thread")), one(2, F.upper(said(k, 2)), F.lit(None).cast("string")), one(3, F.concat(first_words(F.col("text"), 6), F.lit(" ok")), F.lit("")))
    tags = F.array(F.lit("Thing"), F.lit(" "), F.element_at(words(said(k, 2)), -1))
    source_id = F.when(k % 29 == 0, "").otherwise(k.cast("string"))
    return i.select("id", "source", source_id.alias("source_id"), F.when(k % 6 == 0, None).otherwise(F.col("url")).alias("url"), "cluster", title.alias("title"), text.alias("text"), heads.alias("evidence_snippets"), comments.alias("comments"), tags.alias("topic_tags"), "published_at")


_T = "text"
_F5, _F6, _F14 = (sql_first_words(_T, n) for n in (5, 6, 14))
POSTS = f"""v_posts AS (SELECT id, source, CASE WHEN id % 29 = 0 THEN '' ELSE id::VARCHAR END AS source_id, CASE WHEN id % 6 = 0 THEN NULL ELSE url END AS url, cluster,
 CASE WHEN id % 23 = 0 THEN '' ELSE {said_sql('id', 1)} || ' ' || substring(text, 1, 60) END AS title, CASE WHEN id % 19 = 0 THEN '' ELSE coalesce(text, '') || '. ' || {said_sql('id', 2)} || ' now. And ' || {said_sql('id', 3)} || '? ' END AS text,
 CASE WHEN id % 3 < 2 THEN [{_F5}, {said_sql('id', 2)}, {_F14}] ELSE []::VARCHAR[] END AS evidence_snippets,
 [{{'text': 'yes ' || {said_sql('id', 2)} || ' today', 'post_url': 'http://thread', 'comment_id': 'c1-' || id, 'comment_url': 'http://c1/' || id}}, {{'text': upper({said_sql('id', 2)}), 'post_url': NULL, 'comment_id': 'c2-' || id, 'comment_url': 'http://c2/' || id}},
  {{'text': {_F6} || ' ok', 'post_url': '', 'comment_id': 'c3-' || id, 'comment_url': 'http://c3/' || id}}] AS comments,
 ['Thing', ' ', ({sql_words(said_sql('id', 2))})[-1]] AS topic_tags, published_at FROM v_items)"""

# ---- cards: documents cut into the fields of cards, with every fault that a rule looks for

HN = "https://news.ycombinator.com/item?id="


#: Words that a card is made of, and the number of cards that the ids of a document have room for.
CARD_WORDS, CARD_IDS = 60, 1009


def card_words(spark: SparkSession, sf: str) -> DataFrame:
    """(id, w): whole texts cut into runs of words, each a card's; a text without a word is one, too."""
    def cut(w: Column) -> Column:
        last = F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / CARD_WORDS).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * CARD_WORDS + 1, F.lit(CARD_WORDS)))

    parts = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(let(words(F.col("text")), cut)).alias("at", "w"))
    return parts.select((F.col("doc_id") * CARD_IDS + F.col("at")).alias("id"), "w")


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """(id, card, allowed)."""
    k = F.col("id")
    d = card_words(spark, sf)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    seg = lambda a, n: F.array_join(F.slice("w", lit(a) + 1, lit(n)), " ")
    pick = lambda n, *xs: F.element_at(F.array(*map(lit, xs)), (k % n + 1).cast("int"))
    num = k.cast("string")
    title = pick(7, "Software supply chain woe", F.concat(seg(0, 4), F.lit(" can break")), "", "One api fails overnight", *[seg(0, (2 + k % 12).cast("int"))] * 3)
    problem = F.when(k % 9 == 0, "This highlights a need").when(k % 9 == 8, "").otherwise(seg(8, 12))

    def bullet(j):
        at = k + j
        post = F.when(at % 3 == 0, "").when(at % 3 == 1, F.concat(F.lit("http://x/"), (k % 40).cast("string"))).otherwise(F.when(k % 2 == 0, F.concat(F.lit(" http://x/"), (k % 20).cast("string"))).otherwise(F.concat(F.lit("http://bad/"), num)))
        comment = F.when(at % 4 == 0, "").when(at % 4 == 1, F.concat(F.lit(HN), num)).when(at % 4 == 2, F.concat(F.lit("http://x/"), (k % 20).cast("string"))).otherwise(F.when(k % 5 == 0, F.concat(F.lit("http://bad/"), num)))
        return F.struct(seg(j * 5, (4 + at % 11).cast("int")).alias("quote"), post.alias("post_url"), comment.alias("comment_url"))

    evidence = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), (k % 4).cast("int") - 1), bullet)).otherwise(F.array().cast("array<struct<quote: string, post_url: string, comment_url: string>>"))
    wedge = F.when(k % 13 != 0, F.struct(pick(3, "", "icp", "raises questions about x").alias("icp"), pick(5, "", "an idea only", *["a small cli checker"] * 3).alias("mvp"), pick(4, "", *["saves hours"] * 3).alias("why_they_pay"), F.lit("forums").alias("first_channel"), F.lit("no agents").alias("anti_feature")))
    card = F.struct(
        title.alias("title"), F.when(k % 10 == 0, "").otherwise(seg(3, (6 + k % 11).cast("int"))).alias("hook"), problem.alias("problem"), pick(6, "", "developers", *[F.concat(F.lit("Platform team "), seg(1, 2))] * 4).alias("who_is_affected"), evidence.alias("evidence"),
        pick(8, "", "Developers", "ops", "Security lead at banks", *[seg(2, 3)] * 4).alias("who_pays"), pick(2, "", "They stop early.").alias("why_existing_tools_fail"),
        pick(3, F.array().cast("array<string>"), F.array(F.lit("Hours lost each week")), F.array(F.lit("nothing at all"), F.lit(""))).alias("stakes"), pick(11, F.array(F.lit("need for robust thing")), *[F.array(F.lit("now"), F.lit("later"))] * 10).alias("why_now"),
        wedge.alias("wedge"), pick(5, "high", "Med", "low", "sure", "").alias("confidence"), F.when(k % 12 == 0, "").otherwise("no users").alias("kill_criteria"),
    )
    allowed = F.array(*[F.lit(f"http://x/{j}") for j in range(20)], F.concat(F.lit(HN), num))
    return d.select("id", card.alias("card"), allowed.alias("allowed"))


def _pick(n: int, *xs: str) -> str:
    return f"(CASE id % {n} " + " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(xs)) + " END)"


def _seg(a: str, n: str) -> str:
    return f"array_to_string(w[({a}) + 1:({a}) + ({n})], ' ')"


CARDS = f"""v_words AS (SELECT doc_id * {CARD_IDS} + part_ AS id, w[part_ * {CARD_WORDS} + 1:part_ * {CARD_WORDS} + {CARD_WORDS}] AS w FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 0) // {CARD_WORDS} + 1)) AS part_ FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))),
v_cards AS (SELECT id, {_pick(7, "'Software supply chain woe'", _seg('0', '4') + " || ' can break'", "''", "'One api fails overnight'", *[_seg('0', '2 + id % 12')] * 3)} AS title, CASE WHEN id % 10 = 0 THEN '' ELSE {_seg('3', '6 + id % 11')} END AS hook,
 CASE WHEN id % 9 = 0 THEN 'This highlights a need' WHEN id % 9 = 8 THEN '' ELSE {_seg('8', '12')} END AS problem, {_pick(6, "''", "'developers'", *["'Platform team ' || " + _seg('1', '2')] * 4)} AS who_is_affected,
 list_transform(range(id % 4), lambda j: {{'quote': array_to_string(w[j * 5 + 1:j * 5 + 4 + (id + j) % 11], ' '),
  'post_url': CASE (id + j) % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://x/' || (id % 40) ELSE CASE WHEN id % 2 = 0 THEN ' http://x/' || (id % 20) ELSE 'http://bad/' || id END END,
  'comment_url': CASE (id + j) % 4 WHEN 0 THEN '' WHEN 1 THEN '{HN}' || id WHEN 2 THEN 'http://x/' || (id % 20) ELSE CASE WHEN id % 5 = 0 THEN 'http://bad/' || id END END}}) AS evidence,
 {_pick(8, "''", "'Developers'", "'ops'", "'Security lead at banks'", *[_seg('2', '3')] * 4)} AS who_pays, {_pick(2, "''", "'They stop early.'")} AS why_existing_tools_fail, {_pick(3, "[]::VARCHAR[]", "['Hours lost each week']", "['nothing at all', '']")} AS stakes,
 {_pick(11, "['need for robust thing']", *["['now', 'later']"] * 10)} AS why_now, id % 13 <> 0 AS has_wedge, {_pick(3, "''", "'icp'", "'raises questions about x'")} AS icp, {_pick(5, "''", "'an idea only'", *["'a small cli checker'"] * 3)} AS mvp,
 {_pick(4, "''", *["'saves hours'"] * 3)} AS why_they_pay, 'forums' AS first_channel, 'no agents' AS anti_feature, {_pick(5, "'high'", "'Med'", "'low'", "'sure'", "''")} AS confidence, CASE WHEN id % 12 = 0 THEN '' ELSE 'no users' END AS kill_criteria,
 list_transform(range(20), lambda j: 'http://x/' || j) || ['{HN}' || id] AS allowed FROM v_words)"""
