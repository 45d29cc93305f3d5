"""From clusters and catalysts to a day's report: gates, payloads, accepted cards, assembly, and the sample report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, lexicons, normalise, render, scoring, validate
from ..functions.text import first_n, nz, strip
from .relational import greedy_disjoint

_NONE = "array<string>"
# Phrases of a summary that found nothing.
EMPTY_SUMMARY = ["unclear from evidence", "not enough evidence"]

#: The fields of validate.CARD inside of a struct.
_CARD_FIELDS = (
    "title: string, hook: string, problem: string, who_is_affected: string, evidence: array<struct<quote: string, post_url: string, comment_url: string>>, who_pays: string, why_existing_tools_fail: string, stakes: array<string>, why_now: array<string>, "
    "wedge: struct<icp: string, mvp: string, why_they_pay: string, first_channel: string, anti_feature: string>, confidence: string, kill_criteria: string"
)
SAMPLE = (
    "date string, clusters array<struct<id: string, title: string, summary: string, persona: string, why_matters: string, size: int, score: double, items: array<struct<title: string, text: string, url: string, evidence_snippets: array<string>>>>>, "
    "catalysts array<struct<title: string, summary: string, interests: array<string>, problems_created: string, source_urls: array<string>>>, wildcard struct<title: string, text: string, url: string, evidence_snippets: array<string>>"
)


def eligible(label: Column) -> Column:
    """Whether an item gets evidence snippets."""
    return F.coalesce(label.isin("PAIN", "DISCUSSION"), F.lit(False))


def has_summary(summary: Column) -> Column:
    """Whether a cluster's summary says something."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    return ~F.contains(low, F.lit(EMPTY_SUMMARY[0])) & ~F.contains(low, F.lit(EMPTY_SUMMARY[1]))


def cluster_payloads(clusters: DataFrame, members: DataFrame, labels: DataFrame, most: int = 15) -> DataFrame:
    """(cluster_id, cluster_index, title, summary, snippets, bullets, links, topic_tags, supported) of clusters (id, ...), from their members in order.

    Members are (cluster_id, ordinal, id, source, source_id, url, title, text, evidence_snippets, comments).  Of a
    cluster's members only the first ``most`` feed bullets; snippets, links and tags are cut to ten, five and ten
    before they are gathered, so no list grows with a cluster.  ``supported`` is whether all snippets of all members,
    not the ten that are kept, cohere with all tags.
    """
    tagged = members.join(labels.select("id", "topic_tags"), "id", "left")
    flat = lambda column, name: tagged.select("cluster_id", "ordinal", F.posexplode(F.coalesce(column, F.array().cast(_NONE))).alias("place", "value")).where("value is not null").withColumn("kind", F.lit(name))
    # all snippets count, repeated ones too; of links and tags the first of equal ones
    every = flat(F.col("evidence_snippets"), "snippet").withColumn("key", F.concat_ws("_", "ordinal", "place"))
    links = flat(F.array("url"), "link").where("value <> ''").withColumn("key", F.concat_ws("_", "ordinal", "place"))
    tags = flat(F.col("topic_tags"), "tag").withColumn("key", F.col("value"))
    first = every.unionByName(links).unionByName(tags).groupBy("cluster_id", "kind", "key").agg(F.min(F.struct("ordinal", "place", "value")).alias("v"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy("v.ordinal", "v.place"))
    listed = lambda name, n: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("n") <= n), F.struct("n", "v.value")))), lambda x: x["value"]).alias(name)
    lists = first.withColumn("n", rank).where("n <= 10").groupBy("cluster_id").agg(listed("snippet", 10), listed("link", 5), listed("tag", 10))
    item = F.struct("source", "source_id", "url", "evidence_snippets", "comments")
    some = members.where(F.col("ordinal") < most).select("cluster_id", "ordinal", evidence.bullets(item).alias("b")).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "b"))).alias("all"))
    some = some.select("cluster_id", first_n(F.flatten(F.transform("all", lambda x: x["b"])), 15).alias("bullets"))
    empty = lambda c: F.coalesce(c, F.array().cast(_NONE))
    own = clusters.select(F.col("id").alias("cluster_id"), "cluster_index", nz(F.col("title"), "").alias("title"), nz(F.col("summary"), "").alias("summary"), first_n(F.coalesce("example_urls", F.array().cast(_NONE)), 5).alias("known"))
    joined = own.join(lists, "cluster_id", "left").join(some, "cluster_id", "left").join(support(every, tags).select("cluster_id", "supported"), "cluster_id", "left")
    bullets = F.coalesce("bullets", F.array().cast("array<struct<quote: string, post_id: string, post_url: string, comment_id: string, comment_url: string>>"))
    return joined.select("cluster_id", "cluster_index", "title", "summary", empty("snippet").alias("snippets"), bullets.alias("bullets"), F.when(F.size("known") > 0, F.col("known")).otherwise(empty("link")).alias("links"), empty("tag").alias("topic_tags"), F.coalesce("supported", F.lit(False)).alias("supported"))


def support(snippets: DataFrame, tags: DataFrame) -> DataFrame:
    """(cluster_id, direct, hits, supported) of all snippets (cluster_id, ordinal, place, value) and tags (cluster_id, value): the coherence test by counts, so no list of them is made.

    ``direct`` are the indicators that the snippets, joined in order, hold; the longest has two words, so it lies in
    one snippet or over two that adjoin.  ``hits`` are the snippets that hold any tag of the cluster; a repeated one is tested once.
    """
    from pyspark.sql import Window

    after = F.lead("value").over(Window.partitionBy("cluster_id").orderBy("ordinal", "place"))
    joined = snippets.select("cluster_id", F.lower(F.concat_ws(" ", "value", after)).alias("said"))
    direct = joined.groupBy("cluster_id").agg(*[F.max(F.contains("said", F.lit(w)).cast("int")).alias(f"_{k}") for k, w in enumerate(lexicons.DIRECT_INDICATORS)])
    direct = direct.select("cluster_id", sum((F.col(f"_{k}") for k in range(1, len(lexicons.DIRECT_INDICATORS))), F.col("_0")).cast("long").alias("direct"))
    known = tags.select("cluster_id", F.lower(strip(F.col("value"))).alias("tag")).where("tag <> ''").distinct()
    said = snippets.groupBy("cluster_id", "value").agg(F.count("*").alias("n"))
    held = said.join(known, "cluster_id").where("contains(lower(value), tag)").select("cluster_id", "value", "n").distinct()
    both = direct.join(held.groupBy("cluster_id").agg(F.sum("n").alias("hits")), "cluster_id", "left").select("cluster_id", "direct", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return both.withColumn("supported", (F.col("direct") >= 1) | (F.col("hits") >= 2))


def coherent(payloads: DataFrame) -> DataFrame:
    """Payloads whose evidence supports their topic, and whose summary says something."""
    return payloads.where(F.col("supported") & has_summary(F.col("summary")))


def distinct_catalysts(catalysts: Column) -> Column:
    """Catalysts whose tags are new, or which say what they connect to, in order."""
    tags = lambda c: F.filter(F.transform(first_n(F.coalesce(c["topic_tags"], F.array().cast(_NONE)), 5), lambda t: F.lower(strip(F.coalesce(t, F.lit(""))))), lambda t: t != "")
    rows = F.transform(catalysts, lambda c, i: F.struct(i.alias("ordinal"), tags(c).alias("keys"), c["connects_to"].alias("connects")))
    kept = greedy_disjoint(rows, "keys", lambda r: F.coalesce(strip(r["connects"]), F.lit("")) != "")
    return normalise.picked(catalysts, kept)


def allowed_urls(payloads: Column) -> Column:
    """Addresses that cards may cite: the first ten links and twenty bullets of each payload, once each."""
    clean = lambda u: strip(F.coalesce(u, F.lit("")))
    links = F.flatten(F.transform(payloads, lambda p: F.concat(F.transform(first_n(p["links"], 10), clean), F.flatten(F.transform(first_n(p["bullets"], 20), lambda b: F.array(clean(b["post_url"]), clean(b["comment_url"])))))))
    return F.array_distinct(F.filter(links, lambda u: u != ""))


def accept_cards(cards: DataFrame, allowed: str = "allowed", card: str = "card", warned: str | None = None) -> DataFrame:
    """The rows with ``card`` repaired where needed, ``accepted``, ``warnings`` and ``errors``.

    A hard error drops a card.  With soft errors or warnings only it is repaired and checked again; what is left of
    them is listed as warnings.
    """
    first = cards.withColumn("_v1", validate.card_errors(F.col(card), F.col(allowed)))
    hard, loose = F.size("_v1.hard") > 0, (F.size("_v1.soft") + F.size("_v1.warnings")) > 0
    again = first.withColumn("_card", F.when(~hard & loose, validate.repaired(F.col(card))).otherwise(F.col(card)))
    again = again.withColumn("_v2", F.when(~hard & loose, validate.card_errors(F.col("_card"), F.col(allowed))))
    dropped = hard | F.coalesce(F.size("_v2.hard") > 0, F.lit(False))
    none = F.array().cast(_NONE)
    errors = F.when(hard, F.concat("_v1.hard", "_v1.soft")).when(dropped, F.concat("_v2.hard", "_v2.soft")).otherwise(none)
    own = F.coalesce(F.col(warned), none) if warned else none
    warnings = F.when(dropped, none).when(loose, F.concat(own, "_v1.warnings", "_v2.warnings", "_v2.soft")).otherwise(own)
    return again.withColumns({card: F.col("_card"), "accepted": ~dropped, "warnings": warnings, "errors": errors}).drop("_v1", "_v2", "_card")


def gathered(cards: DataFrame, *more: Column) -> DataFrame:
    """(date, cards, drops, ...) of checked cards (date, ordinal, card, accepted, warnings, errors); ``more`` are aggregates over a day's rows."""
    return cards.groupBy("date").agg(
        F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("ordinal", "card", "warnings")))).alias("cards"),
        F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.struct("ordinal", nz(F.col("card.title"), "").alias("title"), "errors")))).alias("drops"), *more,
    )


def listed_rejects() -> Column:
    """Of rows (ordinal, kind, index, reason): the rejects of a day in order."""
    return F.array_sort(F.collect_list(F.struct("ordinal", "kind", "index", "reason"))).alias("rejects")


def assemble(name: str, cards: DataFrame, rejects: DataFrame | None = None, bets: DataFrame | None = None) -> DataFrame:
    """(date, markdown): a report per day of checked cards (date, ordinal, card, accepted, warnings, errors).

    ``rejects`` are (date, ordinal, kind, index, reason) of the gate, ``bets`` (date, bet).  A day's cards are few
    (an answer holds five), and so are its rejects.
    """
    out = gathered(cards)
    if rejects is not None:
        out = out.join(rejects.groupBy("date").agg(listed_rejects()), "date", "left")
    else:
        out = out.withColumn("rejects", F.lit(None).cast("array<struct<ordinal: bigint, kind: string, index: string, reason: string>>"))
    return reports(name, out.join(bets, "date", "left") if bets is not None else out.withColumn("bet", F.lit(None).cast("string")))


def reports(name: str, days: DataFrame) -> DataFrame:
    """(date, markdown) of days (date, cards, drops, rejects, bet)."""
    gone = F.coalesce("rejects", F.array().cast("array<struct<ordinal: bigint, kind: string, index: string, reason: string>>"))
    bet = nz(F.col("bet"), normalise.NO_DATA)
    return days.select("date", render.report_markdown(F.lit(name), F.col("date").cast("string"), F.col("cards"), bet, gone, F.col("drops")).alias("markdown"))


def empty_report(name: str, date: str = "date", bet: str = "bet", rejects: str = "rejects") -> Column:
    """The report of a day without any card."""
    gone = F.coalesce(F.col(rejects), F.array().cast("array<struct<ordinal: bigint, kind: string, index: string, reason: string>>"))
    cards = F.array().cast(f"array<struct<ordinal: bigint, card: struct<{_CARD_FIELDS}>, warnings: array<string>>>")
    drops = F.array().cast("array<struct<ordinal: bigint, title: string, errors: array<string>>>")
    return render.report_markdown(F.lit(name), F.col(date).cast("string"), cards, nz(F.col(bet), normalise.NO_DATA), gone, drops)


# ---- the sample report: the whole way without a model


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """Sample data from a JSON file; a cluster's size is the number of its items."""
    rows = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    return rows.withColumn("clusters", F.transform("clusters", lambda c: c.withField("size", F.coalesce(F.size(c["items"]), F.lit(0)))))


def _drafted(title: Column, summary: Column, persona: Column, why: Column, found: Column, grade: Column) -> Column:
    return render.plain_item(F.struct(title.alias("title"), summary.alias("summary"), persona.alias("persona"), why.alias("why_matters")), found, grade)


def sample_report(data: DataFrame, name: str) -> DataFrame:
    """data with the column markdown: a report of clusters, catalysts and a wildcard, from their own texts only."""
    backed = lambda e: (F.size(e["links"]) > 0) | (F.size(e["snippets"]) > 0)

    def of_cluster(c: Column) -> Column:
        found = evidence.bundle(F.coalesce(c["items"], F.array().cast("array<struct<title: string, text: string, url: string, evidence_snippets: array<string>>>")))
        score = F.coalesce(F.nullif(c["score"], F.lit(0.0)), F.lit(0.5))
        item = _drafted(c["title"], c["summary"], c["persona"], c["why_matters"], found, scoring.signal_strength(c["size"], score, F.lit(0.6)))
        return F.struct(backed(found).alias("ok"), item.alias("item"), scoring.buildability_pain(item["strength_or_impact"], item["who"], item["wedge"]).alias("score"), render.item_markdown(item, F.lit("pain")).alias("md"))

    def of_catalyst(c: Column) -> Column:
        found = evidence.catalyst_bundle(c["title"], c["summary"], c["source_urls"])
        problems = nz(c["problems_created"], "")
        urgent = scoring.is_urgent(F.concat(nz(c["summary"], ""), F.lit(" "), problems))
        grade = scoring.impact(F.coalesce(F.size(c["interests"]), F.lit(0)), F.coalesce(F.size(c["source_urls"]), F.lit(0)), urgent)
        item = _drafted(c["title"], c["summary"], F.lit(""), c["problems_created"], found, grade)
        return F.struct(backed(found).alias("ok"), item.alias("item"), scoring.buildability_catalyst(item["strength_or_impact"], problems).alias("score"), render.item_markdown(item, F.lit("catalyst")).alias("md"))

    def of_wildcard(w: Column) -> Column:
        item = _drafted(w["title"], F.substring(nz(w["text"], ""), 1, 200), F.lit(""), F.lit(""), evidence.bundle(F.array(w)), F.lit("Med"))
        return F.struct(F.lit(True).alias("ok"), item.alias("item"), scoring.buildability_pain(F.lit("Med"), item["who"], item["wedge"]).alias("score"), render.item_markdown(item, F.lit("pain")).alias("md"))

    titles = lambda a: F.transform(first_n(a, 5), lambda c: nz(c["title"], ""))
    rows = data.withColumns({"_pain": F.filter(F.transform(first_n(F.col("clusters"), 5), of_cluster), lambda x: x["ok"]), "_news": F.filter(F.transform(first_n(F.col("catalysts"), 5), of_catalyst), lambda x: x["ok"])})
    rows = rows.withColumn("_wild", F.when(F.col("wildcard").isNotNull(), F.array(of_wildcard(F.col("wildcard")))).otherwise(F.slice("_pain", 1, 0)))
    line = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    themes = render.pattern_language(titles(F.col("clusters")), titles(F.col("catalysts")))
    bets = F.transform(F.concat("_pain", "_news", "_wild"), lambda x, i: F.struct(i.alias("ordinal"), x["score"].alias("score"), x["item"]["wedge"].alias("wedge")))
    shown = lambda c: F.transform(F.col(c), lambda x: x["md"])
    lines = F.concat(
        line(F.concat(F.lit(f"# {name} — "), F.col("date")), "", render.INTRO, "", ""), F.when(themes != "", line(themes, "")).otherwise(F.array().cast(_NONE)), line("## 1. Top Pain Clusters", ""), shown("_pain"),
        line("## 2. Rising Pain Signals", "", "No clear risers today.", "", "## 3. Catalyst Signals", ""), shown("_news"), line("## 4. Wildcard", ""),
        F.when(F.size("_wild") > 0, shown("_wild")).otherwise(line("*(None this time.)*", "")), line("---", "", render.one_bet(bets), ""),
    )
    return rows.withColumn("markdown", F.array_join(lines, "\n")).drop("_pain", "_news", "_wild")
