"""A day from its items to its report: labels, clusters, cards, with one model behind one interface.

Each step is written to the tables, which cuts lineage, and answers go through
the tables' ledger, so a model is asked once whatever is lost or run again.  Lists in single rows are those
of a day's prompts and hold at most the numbers of the prompts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence, lexicons, normalise, prompts, scoring
from ..functions.text import nz
from ..sources import provider as models
from . import relational, report, topics
from .tables import Tables
from .work import kept as _kept

_NONE = "array<string>"
_SCORES = ("audience_fit", "pain_intensity", "actionability")


def label(tables: Tables, day, provider: Callable[[], models.ModelProvider]) -> None:
    """Labels, scores and evidence snippets of a day's items; an item without an answer is OTHER, with the reason error."""
    items = tables.items_of(day)
    rows = items.select("id", "title", "text", prompts.classify(F.col("title"), F.col("text")).alias("prompt"))
    a = tables.ledger().generate(rows, "prompt", "answer", provider).withColumn("a", models.label_answer(F.col("answer")))
    failed = F.col("answer").isNull()
    zero = lambda k: F.when(failed, 0.0).otherwise(F.col(f"a.{k}")).alias(k)
    pain = scoring.combined_pain(scoring.pain_heuristic(F.substring("text", 1, 8000), F.substring("title", 1, 500)), F.col("label"), F.col("confidence"))
    told = a.select(
        F.col("id").alias("raw_item_id"), "title", "text", F.when(failed, "OTHER").otherwise(F.col("a.label")).alias("label"), zero("confidence"), *map(zero, _SCORES), "a.evidence_spans", "a.topic_tags", "a.claim_anchors",
        F.when(failed, "error").otherwise(F.col("a.exclude_reason")).alias("exclude_reason"),
    )
    tables.put_labels(_kept(told.withColumn("pain_score", pain).drop("title", "text")), day)
    fit = items.join(tables.labels_of(items).where(report.eligible(F.col("label"))).select(F.col("raw_item_id").alias("id")), "id", "left_semi")
    said = F.transform("metadata.comments", lambda c: c["text"])
    tables.put_snippets(_kept(fit.select("id", evidence.snippets(F.col("title"), F.col("text"), said).alias("evidence_snippets")).where(F.size("evidence_snippets") > 0)))


def cluster(tables: Tables, day, provider: Callable[[], models.ModelProvider], top: int = 50) -> None:
    """Ranks a day's items, lets the editor choose, and replaces the day's clusters.  Without candidates the day has none."""
    items = tables.items_of(day)
    labels = tables.labels_of(items).withColumnRenamed("raw_item_id", "id")
    place = Window.orderBy(F.desc("signal_score"), F.desc_nulls_last("published_at"), "id")  # over at most ``top`` rows
    ranked = _kept(relational.rank_candidates(items, labels, top).withColumn("ordinal", F.row_number().over(place)))
    fields = ("id", "title", "url", "label", *_SCORES, "evidence_spans")
    one = ranked.agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("all")).where(F.size("all") > 0)
    answer = _kept(tables.ledger().generate(one.select(prompts.editor(F.col("all")).alias("prompt")), "prompt", "answer", provider).select(models.editor_answer(F.col("answer")).alias("e")))
    named = answer.where("e is not null").select(F.explode(F.array_union("e.featured", "e.secondary")).alias("id"))
    fallback = relational.gate_fallback(ranked.select("id", "label", "ordinal")).where("featured").select("id")
    chosen = items.join(named if answer.where("e is not null").limit(1).count() else fallback, "id", "left_semi")
    posts = _kept(chosen.select("id", "url", "published_at", F.concat(nz(F.col("title"), ""), F.lit(" "), nz(F.col("text"), "")).alias("body")))
    if posts.limit(1).count() == 0:
        tables.delete_day("clusters", day)
        return
    vectors = _kept(tables.ledger().embed(posts.select("id", "body"), "body", "embedding", provider))
    tables.put_embeddings(vectors.where("embedding is not null").select(F.col("id").alias("raw_item_id"), "embedding", F.lit("given").alias("model")), day)
    grouped = _kept(topics.cluster_posts(posts, "id", "body", vectors).withColumn("cluster_index", F.col("cluster").cast("int")).drop("cluster"))
    both = posts.join(grouped, "id").join(labels.select("id", "pain_score"), "id", "left")
    both = both.withColumn("ordinal", F.row_number().over(Window.partitionBy("cluster_index").orderBy(F.desc_nulls_last("published_at"), "id")))
    listed = topics.top_terms(both, "cluster_index", "id", "body", 5, topics.STOP_WORDS).groupBy("cluster_index").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    terms = listed.select("cluster_index", F.transform("t", lambda x: x["term"]).alias("top_terms"))
    sizes = both.groupBy("cluster_index").agg(F.count("*").cast("int").alias("size"), F.round(F.avg(F.coalesce("pain_score", F.lit(0.0))), 2).alias("score"))
    urls = relational.first_distinct(both, ["cluster_index"], "url", "ordinal", 5, "example_urls")
    date = F.lit(day).cast("date")
    own = sizes.join(terms, "cluster_index", "left").join(urls, "cluster_index", "left").withColumns({"date": date, "id": F.sha2(F.concat_ws("/", F.lit(str(day)), "cluster_index"), 256)})
    own = own.withColumns({"title": F.substring(nz(F.get("top_terms", F.lit(0)), "Pain cluster"), 1, 200), "summary": F.lit(""), "persona": F.lit(""), "why_matters": F.lit("")})
    members = grouped.select(date.alias("date"), F.sha2(F.concat_ws("/", F.lit(str(day)), "cluster_index"), 256).alias("cluster_id"), F.col("id").alias("raw_item_id"))
    tables.put_clusters(_kept(own), members)


def analyze(tables: Tables, day, provider: Callable[[], models.ModelProvider]) -> None:
    label(tables, day, provider)
    cluster(tables, day, provider)


def _members(tables: Tables, day) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("published_at"), "id")
    return tables.cluster_members(day).select("*", (F.row_number().over(order) - 1).alias("ordinal"), F.col("metadata.comments").alias("comments"))


def summarise(tables: Tables, day, provider: Callable[[], models.ModelProvider]) -> None:
    """Writes up each cluster of a day from its first fifteen members."""
    few = _members(tables, day).where("ordinal < 15").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "text", "url"))).alias("m"))
    rows = tables.clusters_of(day).join(few, F.col("id") == F.col("cluster_id")).select("id", "title", "summary", "persona", "why_matters", F.filter(F.transform("m", lambda x: x["url"]), lambda u: nz(u, "") != "").alias("links"), prompts.cluster(F.col("m")).alias("prompt"))
    told = tables.ledger().generate(rows, "prompt", "answer", provider)
    s = normalise.cluster_summary(F.col("answer"), F.col("title"), F.col("summary"), F.col("persona"), F.col("why_matters"), F.col("links"))
    tables.set_cluster_texts(day, _kept(told.select("id", s.alias("s")).select("id", "s.title", "s.summary", "s.persona", "s.why_matters", "s.example_urls")))


def publish(tables: Tables, day, provider: Callable[[], models.ModelProvider], name: str, path: str | None = None) -> None:
    """The day's report, from its clusters and news; replaces the day's catalysts and report."""
    items = tables.items_of(day)
    labels = tables.labels_of(items).withColumnRenamed("raw_item_id", "id")
    date = F.lit(day).cast("date")
    ask = lambda df, prompt: tables.ledger().generate(df.withColumn("_p", prompt), "_p", "answer", provider)
    payloads = _kept(report.cluster_payloads(tables.clusters_of(day), _members(tables, day).drop("cluster_index"), labels))
    # only a title that its evidence does not support is asked for anew, and kept
    renamed = ask(payloads, F.when(~F.col("supported"), prompts.rename(F.col("title"), F.col("snippets"), "a short phrase that the snippets support")))
    renamed = _kept(renamed.withColumn("title", F.when(F.col("supported"), F.col("title")).otherwise(normalise.new_title(F.col("answer"), F.col("title"), F.col("snippets")))).drop("_p", "answer"))
    tables.set_cluster_texts(day, renamed.where(~F.col("supported")).select(F.col("cluster_id").alias("id"), "title"))
    passed = _kept(report.coherent(renamed))
    # the first thirty news items of the day
    news = items.join(labels.select("id", "label"), "id", "left").where((F.col("source") == "rss") | (F.col("label") == "NEWS")).orderBy(F.desc_nulls_last("published_at"), "id").limit(30)
    listed = news.agg(F.collect_list(F.struct("title", "url", F.substring("text", 1, 800).alias("text"))).alias("n")).where(F.size("n") > 0)
    found = ask(listed, prompts.news(F.col("n"), lexicons.EXCLUDED)).select(normalise.catalysts(F.col("answer")).alias("c"))
    blank = items.sparkSession.range(1).select(F.from_json(F.lit("[]"), found.schema["c"].dataType).alias("none"))
    cats = _kept(blank.join(found, how="left").select(F.coalesce("c", "none").alias("c")))  # one row each
    each = cats.select(F.posexplode("c").alias("ordinal", "x")).select("ordinal", "x.*").withColumn("problems_created", normalise.problems_text(F.col("problems_created")))
    tables.put_catalysts(each.withColumns({"date": date, "id": F.sha2(F.concat_ws("/", F.lit(str(day)), "ordinal"), 256), "title": nz(F.col("title"), "News")}), day)
    fields = ("title", "summary", "snippets", "bullets", "links", "topic_tags")
    pain = passed.agg(F.array_sort(F.collect_list(F.struct("cluster_index", *fields))).alias("pain"))
    both = pain.join(cats.select(report.distinct_catalysts(F.col("c")).alias("cats")))  # one row each
    gate = normalise.gate_answer(F.col("answer"), F.size("pain"), F.size("cats"))
    gated = ask(both, prompts.gate(F.col("pain"), F.col("cats"))).withColumn("g", F.when((F.size("pain") > 0) | (F.size("cats") > 0), gate))
    chosen = _kept(gated.select(normalise.picked(F.col("pain"), F.col("g.pain")).alias("pain"), normalise.picked(F.col("cats"), F.col("g.catalysts")).alias("cats"), F.coalesce("g.rejects", F.array().cast("array<struct<kind: string, index: string, reason: string>>")).alias("rejects")))
    one = chosen.select(F.posexplode("pain").alias("at", "p")).select("at", "p.*")
    named = ask(one, prompts.rename(F.col("title"), F.col("snippets"), "six to ten words that name a failure")).withColumn("title", normalise.new_title(F.col("answer"), F.col("title"), F.col("snippets")))
    titled = named.agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("pain"))
    ready = _kept(titled.join(chosen.drop("pain")).withColumn("allowed", report.allowed_urls(F.col("pain"))))  # one row each
    some = (F.size("pain") > 0) | (F.size("cats") > 0)
    made = ask(ready.where(some), prompts.compose(F.col("pain"), F.col("cats"))).select("allowed", F.posexplode(normalise.cards(F.col("answer"))).alias("ordinal", "card"))
    checked = report.accept_cards(made.withColumn("_own", F.col("card.card_warnings")).withColumn("card", F.col("card").dropFields("card_warnings")), warned="_own")
    checked = _kept(checked.withColumn("date", F.lit(str(day))))
    good = checked.where("accepted").agg(F.array_sort(F.collect_list(F.struct("ordinal", "card.title", "card.problem"))).alias("cards"))
    bets = _kept(ask(good, prompts.bet(F.col("cards"))).select(F.lit(str(day)).alias("date"), normalise.bet_line(F.col("answer"), F.size("cards")).alias("bet")))
    rejects = ready.select(F.lit(str(day)).alias("date"), F.posexplode("rejects").alias("ordinal", "r")).select("date", "ordinal", "r.*")
    out = report.assemble(name, checked, rejects, bets)
    if checked.limit(1).count() == 0:
        # no cards: a draft report with the gate's rejects
        row = bets.join(rejects.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "index", "reason"))).alias("rejects")), "date", "left")
        out = row.select("date", report.empty_report(name).alias("markdown"))
    tables.put_report(_kept(out.select(F.to_date("date").alias("date"), "markdown")), path)


def run(tables: Tables, day, provider: Callable[[], models.ModelProvider], name: str, path: str | None = None) -> None:
    """Clusters must be there already (``analyze``)."""
    summarise(tables, day, provider)
    publish(tables, day, provider, name, path)
