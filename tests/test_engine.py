"""Stores, sources, the model boundary, answers, reports and streams, end to end on small data."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from oreline.functions import lexicons, normalise, render, text, validate
from oreline.operators import intake, relational, report, store, topics
from oreline.operators.tables import Tables, seeds
from oreline.sources import feeds, landed, provider
from oreline.streaming import ingest

DAY = "2024-02-03"


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture
def tables(spark, tmp_path, checkpoints):
    return Tables(spark, str(tmp_path / "tables"))


def items(spark, rows, day=DAY):
    """rows: (source, source_id, url, title, text, published second)."""
    df = spark.createDataFrame(rows, "source string, source_id string, url string, title string, text string, t long")
    return df.select(*[F.col(c) for c in df.columns if c != "t"], F.timestamp_seconds("t").alias("published_at"), F.lit(day).cast("timestamp").alias("fetched_at"))


def test_items_upsert(spark, tables):
    assert tables.read("raw_items").count() == 0
    tables.put_items(items(spark, [("hn", "1", "http://old", "one", "x" * 100_001, 5), ("rss", "1", None, None, "t", 9), ("hn", "2", "u", "a", "b", 1), ("hn", "2", "u2", "newer", "b", 2)]))
    tables.put_snippets(tables.read("raw_items").where("source = 'hn'").select("id", F.array(F.lit("s")).alias("evidence_snippets")))
    tables.put_items(items(spark, [("hn", "1", "http://new", "two", "y", 6)], "2024-02-04"))
    got = {(r.source, r.source_id): r for r in tables.read("raw_items").collect()}
    # the first address and the stored snippets stay, everything else is new
    one = got["hn", "1"]
    assert (one.url, one.title, one.text, one.evidence_snippets) == ("http://old", "two", "y", ["s"]) and len(got) == 3
    assert got["rss", "1"].title == "" and got["hn", "2"].title == "newer"
    assert [r.source_id for r in tables.items_of(DAY).collect()] == ["1", "2"] and [r.title for r in tables.items_of("2024-02-04").collect()] == ["two"]
    assert len({r.id for r in got.values()}) == 3


def test_labels_and_embeddings(spark, tables):
    ddl = "raw_item_id string, label string, confidence decimal(4,3), audience_fit decimal(4,3), exclude_reason string"
    tables.put_labels(spark.createDataFrame([("a", "PAIN", None, None, "off"), ("b", "NEWS", None, None, None)], ddl))
    tables.put_labels(spark.createDataFrame([("a", "OTHER", None, None, None)], ddl).withColumn("audience_fit", F.lit("0.5").cast("decimal(4,3)")))
    tables.put_labels(spark.createDataFrame([("a", "PAIN", None, None, None)], ddl))
    got = {r.raw_item_id: r for r in tables.labels_of(spark.createDataFrame([("a",), ("zz",), ("a",)], "id string")).collect()}
    # a null score keeps the old one; the reason is always the new one; nulls read as defaults
    assert set(got) == {"a"} and (got["a"].label, got["a"].audience_fit, got["a"].exclude_reason, got["a"].confidence, got["a"].pain_score, got["a"].topic_tags) == ("PAIN", 0.5, None, 0.0, 0.0, [])
    vec = lambda k, v: spark.createDataFrame([(k, v, "m")], "raw_item_id string, embedding array<double>, model string")
    tables.put_embeddings(vec("a", [1.0]))
    tables.put_embeddings(vec("a", [2.0]))
    assert [r.embedding for r in tables.embeddings_of(spark.createDataFrame([("a",)], "id string")).collect()] == [[2.0]]


def cluster(spark, *rows):
    """rows: (id, date, cluster_index, title, score)."""
    return spark.createDataFrame([(i, datetime.date.fromisoformat(d), k, t, s, 2) for i, d, k, t, s in rows], "id string, date date, cluster_index int, title string, score double, size int")


def test_days_of_clusters_and_reports(spark, tables):
    day = lambda rows: spark.createDataFrame([(datetime.date.fromisoformat(d), c, r) for d, c, r in rows], "date date, cluster_id string, raw_item_id string")
    tables.put_items(items(spark, [("hn", str(i), "u", f"t{i}", "x", i) for i in range(3)]))
    ids = {r.source_id: r.id for r in tables.read("raw_items").collect()}
    tables.put_clusters(cluster(spark, ("c1", DAY, 1, "B", 0.5), ("c0", DAY, 0, "A", 0.9), ("p", "2024-02-02", 0, "P", 0.1)), day([(DAY, "c0", ids["0"]), (DAY, "c0", ids["0"]), (DAY, "c0", ids["2"]), (DAY, "c1", ids["1"])]))
    assert [r.id for r in tables.clusters_of(DAY).collect()] == ["c0", "c1"] and [r.id for r in tables.previous_clusters(DAY).collect()] == ["p"]
    assert [r.id for r in tables.previous_clusters("2024-02-04").collect()] == ["c0", "c1"]
    tables.add_members(day([(DAY, "c1", ids["2"]), (DAY, "c0", ids["0"])]))
    assert [(r.cluster_index, r.title) for r in tables.cluster_members(DAY).collect()] == [(0, "t2"), (0, "t0"), (1, "t2"), (1, "t1")]
    tables.set_cluster_texts(DAY, spark.createDataFrame([("c0", "new", "s", None, "w", None)], "id string, title string, summary string, persona string, why_matters string, example_urls array<string>"))
    assert [(r.title, r.summary) for r in tables.clusters_of(DAY).collect()] == [("new", "s"), ("B", None)]
    # one day is replaced, the others stay
    tables.put_clusters(cluster(spark, ("c9", DAY, 0, "only", 0.2)), day([(DAY, "c9", ids["0"])]))
    assert [r.id for r in tables.clusters_of(DAY).collect()] == ["c9"] and tables.clusters_of("2024-02-02").count() == 1 and tables.cluster_members(DAY).count() == 1
    tables.add_clusters(cluster(spark, ("c10", DAY, 1, "more", 0.2)))
    assert tables.clusters_of(DAY).count() == 2
    tables.put_catalysts(spark.createDataFrame([("b", datetime.date.fromisoformat(DAY), "second", 1), ("a", datetime.date.fromisoformat(DAY), "first", 0)], "id string, date date, title string, ordinal int"))
    assert [r.title for r in tables.catalysts_of(DAY).collect()] == ["first", "second"]
    md = spark.createDataFrame([(datetime.date.fromisoformat(DAY), "# Signals — 2024-02-03\n\nOne bet: x\n")], "date date, markdown string")
    tables.put_report(md)
    tables.put_report(md.withColumn("markdown", F.concat("markdown", F.lit("again"))), f"{tables.base}/out")
    assert tables.report_of(DAY).first().markdown.endswith("again") and "".join(r.value + "\n" for r in spark.read.text(f"{tables.base}/out").collect()).startswith("# Signals")
    state = {r.what: (r.n, r.detail) for r in tables.state_of(DAY).collect()}
    assert state["items"][0] == 3 and state["clusters"] == (2, "only (2); more (2)") and state["catalysts"] == (2, "first; second") and state["reports"][0] == 1
    assert tables.report_status("soon")[0] == 400 and tables.report_status("2024-02-30")[0] == 400 and tables.report_status("2024-02-09")[0] == 404
    code, issue = tables.report_status(DAY)
    assert code == 200 and issue.date == DAY and issue.one_bet == "x"
    tables.put_report(md.withColumn("markdown", F.lit("no heading")))
    assert tables.report_status(DAY)[0] == 422
    tables.delete_day("clusters", DAY)
    assert tables.clusters_of(DAY).count() == 0 and tables.cluster_members(DAY).count() == 0 and tables.clusters_of("2024-02-02").count() == 1


def test_seeds(spark, tables):
    interests, sources = seeds(spark)
    tables.seed(interests, sources.unionByName(spark.createDataFrame([("nobody", "rss", "x", 1.0)], sources.schema)))
    tables.seed(interests.withColumn("description", F.lit("new")), sources.withColumn("weight", F.lit(0.0)))
    got = tables.source_list().collect()
    assert len(got) == 26 and {r.weight for r in got} == {0.0} and tables.read("interests").where("description = 'new'").count() == 10
    top = relational.source_weights(tables.source_list()).collect()
    assert (top[0].source_value, top[0].weight) == ("startups", 2.0)


def test_append_needs_no_table(spark, tables):
    tables.add_members(spark.createDataFrame([(datetime.date.fromisoformat(DAY), "c", "r")] * 2, "date date, cluster_id string, raw_item_id string"))
    assert tables.read("cluster_items").count() == 1


# ---- sources


RSS = "<rss><channel><title>F</title><link>http://site</link>{}</channel></rss>"
ATOM = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><link href="http://atom"/><link rel="self" href="http://atom/feed"/>{}</feed>'


def test_feed_files(spark, tmp_path):
    """RSS and Atom beside a broken file: entries, addresses, and the error."""
    entry = "<item><title>T{i}</title><link>http://l/{i}</link><description>D &amp; d</description><pubDate>Sat, 3 Feb 2024 04:00:0{i} GMT</pubDate></item>"
    atom = '<entry><title>A</title><link rel="edit" href="http://edit"/><link rel="alternate" href="http://l/a"/><author><name>N</name><uri>u</uri></author><updated>2024-02-03T04:00:00Z</updated><content>C</content></entry><entry><title>B</title><link href="http://l/b"/><id>urn:b</id></entry>'
    (tmp_path / "feed.xml").write_text(RSS.format("".join(entry.format(i=i) for i in range(4)) + "<item><title>bare</title></item>"))
    (tmp_path / "atom.xml").write_text(ATOM.format(atom))
    (tmp_path / "broken.xml").write_text("<rss><channel><item>")
    (tmp_path / "page.xml").write_text("<html/>")
    (tmp_path / "empty.xml").write_text(" ")
    entries = feeds.read_feeds(spark, str(tmp_path))
    errors = {r.feed_url.split("/")[-1]: r.error for r in entries.where("error IS NOT NULL").collect()}
    assert set(errors) == {"broken.xml", "page.xml", "empty.xml"} and "ParseError" in errors["broken.xml"] and errors["page.xml"] == "ValueError: no feed: html"
    got = {r.title: r for r in landed.feed_items(entries, 20).collect()}
    assert len(got) == 7 and got["T2"].source_id == "http://l/2" and got["T2"].text == "T2\n\nD & d" and got["T2"].published_at.second == 2
    assert got["bare"].url is None and got["bare"].source_id.startswith("http://site_") and got["bare"].published_at is None
    assert (got["A"].url, got["A"].source_id, got["A"].author, got["A"].text, got["A"].published_at.hour) == ("http://l/a", "http://l/a", "N", "A\n\nC", 4)
    assert (got["B"].url, got["B"].source_id, got["B"].metadata.feed_url) == ("http://l/b", "urn:b", "http://atom/feed")
    assert landed.feed_items(entries, 2).count() == 4
    # the same entries landed elsewhere are the same items
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "copy.xml").write_text((tmp_path / "feed.xml").read_text())
    again = landed.feed_items(feeds.read_feeds(spark, str(tmp_path / "other")), 20)
    assert {r.source_id for r in again.collect()} == {r.source_id for r in got.values() if r.title not in "AB"}


def test_fetched_feeds_and_intake(spark, tables, tmp_path):
    """A partition a feed; a feed, and a source, that fails is told of and the others are in."""
    (tmp_path / "a.xml").write_text(RSS.format("".join(f"<item><title>t{i}</title><guid>g{i}</guid></item>" for i in range(30))))
    (tmp_path / "b.xml").write_text("not a feed")
    addresses = [f"file://{tmp_path}/{n}.xml" for n in ("a", "b", "missing")]
    entries = feeds.fetch_feeds(spark, addresses)
    assert entries.rdd.getNumPartitions() == 3
    assert {r.feed_url.split("/")[-1]: (r["n"], r["e"] is not None) for r in entries.groupBy("feed_url").agg(F.count("ordinal").alias("n"), F.max("error").alias("e")).collect()} == {"a.xml": (20, False), "b.xml": (0, True), "missing.xml": (0, True)}
    story = lambda bad: items(spark, [("hn", "1", "u", "a", "b", 1), ("hn", "2", "u", "a", "b", 1)]).withColumn("author", F.raise_error(F.lit("gone")).cast("string") if bad else F.lit("x"))
    told = intake.take_in(tables, DAY, {"stories": lambda: story(False), "listings": lambda: story(True), "unread": lambda: spark.read.parquet(f"{tmp_path}/none"), "feeds": lambda: landed.feed_items(entries)})
    got = {r["name"]: (r["items"], r["error"]) for r in told.collect()}
    assert got["stories"] == (2, None) and got["feeds"] == (20, None) and got["listings"][0] == got["unread"][0] == 0 and "PATH_NOT_FOUND" in got["unread"][1] and got["listings"][1]
    assert tables.items_of(DAY).count() == 22


def test_landed_files_and_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "extra": 5}, {"id": None}]))
    assert [r.id for r in landed.read_landed(spark, str(tmp_path / "a.json"), "id string").collect()] == ["1", None]
    rows = store.align(spark.createDataFrame([(1, "x")], "a int, other string"), "a long, tags array<string>, b string")
    assert rows.columns == ["a", "tags", "b"] and rows.first() == (1, [], None)


def test_daily_stream(spark, tmp_path, checkpoints):
    """Late and repeated rows, over two runs of the stream."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put = lambda n, rows: (src / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "t": t, "v": v}) for k, t, v in rows))
    put(1, [("a", "2024-02-03 10:00:00", 1), ("a", "2024-02-03 10:00:00", 1), ("b", "2024-02-03 23:30:00", 2)])
    for n in (1, 2):
        stream = ingest.daily_items(spark.readStream.schema("k string, t timestamp, v int").json(str(src)), "t", "k")
        ingest.write_daily(stream, out, str(tmp_path / "cp"), "k", "t").awaitTermination()
        if n == 1:
            first = sorted((r.k, r.v, str(r.date)) for r in spark.read.parquet(out).collect())
            put(2, [("b", "2024-02-03 23:40:00", 9), ("c", "2024-02-04 01:00:00", 3), ("old", "2024-02-01 00:00:00", 7)])
    got = sorted((r.k, r.v, str(r.date)) for r in spark.read.parquet(out).collect())
    assert first == [("a", 1, "2024-02-03"), ("b", 2, "2024-02-03")]
    # a repeated key within the lateness counts once; a row beyond it is too late
    assert got == first + [("c", 3, "2024-02-04")]


# ---- models


class Flaky:
    """Fails the first so many calls."""

    def __init__(self, fails, error):
        self.left, self.error, self.calls = fails, error, []

    def generate(self, prompts):
        return self.embed(prompts) and [f" {p}! " for p in prompts]

    def embed(self, texts):
        self.calls.append(len(texts))
        if self.left:
            self.left -= 1
            raise self.error
        return [[float(len(t))] for t in texts]


def test_generate_waits_for_a_limit_only(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    ask = lambda fails, error: sorted(str(r.a) for r in provider.generate(prompts, "p", "a", lambda: Flaky(fails, error), pause=0.0).collect())
    assert ask(2, provider.RateLimited()) == ["a!", "b!"] and ask(3, provider.RateLimited()) == ["None", "None"] and ask(1, ValueError("bad")) == ["None", "None"]
    labels = provider.generate(prompts, "p", "a", provider.StubProvider).select(provider.label_answer(F.col("a")).alias("x")).collect()
    assert all(r.x.label in lexicons.LABELS and r.x.exclude_reason is None for r in labels)


def test_embedding_ladder_and_fallback(spark):
    texts = spark.createDataFrame([(i, f"word{i % 3} alpha " * 3) for i in range(30)], "id long, t string").coalesce(1)
    got = provider.embed(texts, "t", "v", lambda: Flaky(1, ValueError("too large"))).collect()
    assert all(r.v == [float(len(r.t))] for r in got)
    assert [r.v for r in provider.embed(texts, "t", "v", lambda: Flaky(3, ValueError("no"))).collect()] == [None] * 30
    by_vector = topics.cluster_posts(texts, "id", "t", provider.embed(texts, "t", "embedding", provider.StubProvider))
    by_words = topics.cluster_posts(texts, "id", "t", provider.embed(texts, "t", "embedding", lambda: Flaky(9, ValueError("no"))))
    for found in (by_vector, by_words):
        rows = found.collect()
        assert sorted(r["id"] for r in rows) == list(range(30))
    # without vectors the words decide, so texts with the same words are together
    cluster_of = {r["id"]: r["cluster"] for r in rows}
    assert all(cluster_of[i] == cluster_of[i % 3] for i in range(30))


def test_editor_answer(spark):
    answers = ['```json\n{"featured_pain_ids": ["a", 2], "rejects": [{"id": "x", "reason": "duplicate"}]}\n```', "no", None]
    got = [r.e for r in spark.createDataFrame([(a,) for a in answers], "a string").select(provider.editor_answer(F.col("a")).alias("e")).collect()]
    assert got[0].featured == ["a", "2"] and got[0].secondary == [] and got[0].rejects[0].reason == "duplicate" and got[1:] == [None, None]


def test_fields_of_another_kind(spark):
    """Numbers as text and text as numbers, nulls, nested lists and objects in place of strings."""
    answers = [
        '{"label": "pain", "confidence": "0.25", "audience_fit": null, "pain_intensity": "high", "actionability": 7, "evidence_spans": ["a", 5, null, ["b", 1], " "], "topic_tags": "one", "claim_anchors": [true], "exclude_reason": 0}',
        '{"label": ["PAIN"], "confidence": true, "evidence_spans": {"a": 1}}', '{"label": "NEWS"} trailing', '["NEWS"]', "null", "",
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    got = [r.x for r in rows.orderBy("i").select(provider.label_answer(F.col("a")).alias("x")).collect()]
    assert (got[0].label, got[0].confidence, got[0].audience_fit, got[0].pain_intensity, got[0].actionability) == ("PAIN", 0.25, 0.5, 0.5, 1.0)
    assert got[0].evidence_spans == ["a", "5", '["b",1]'] and got[0].topic_tags == [] and got[0].claim_anchors == ["true"] and got[0].exclude_reason == "0"
    assert (got[1].label, got[1].confidence, got[1].evidence_spans, got[1].exclude_reason) == ("OTHER", 0.5, [], None)
    # what stands behind an object is not read
    assert got[2].label == "NEWS" and [x.exclude_reason for x in got[2:]] == [None] + ["parse_fallback"] * 3
    gate = '{"selected_pain_indices": [1, "0", 9, null, "x", 1.0], "selected_catalyst_indices": 3, "rejects": ["no", {"kind": "pain", "index": 2, "reason": ["r"]}]}'
    g = spark.createDataFrame([(gate,)], "a string").select(normalise.gate_answer(F.col("a"), F.lit(3), F.lit(2)).alias("g")).first().g
    assert (g.pain, g.catalysts, [tuple(r) for r in g.rejects]) == ([1, 0, 1], [], [("pain", "2", '["r"]')])
    e = spark.createDataFrame([('{"featured_pain_ids": ["a", 3], "rejects": [1, {"id": 4}]}',)], "a string").select(provider.editor_answer(F.col("a")).alias("e")).first().e
    assert e.featured == ["a", "3"] and e.secondary == [] and [tuple(r) for r in e.rejects] == [("4", None)]


def test_answers_that_are_not_lists(spark):
    for read in (normalise.catalysts, normalise.cards, normalise.idea_cards):
        rows = spark.createDataFrame([("{}",), ("",), (None,), ("[",), ("[1, null]",), ("[]",)], "a string").select(F.size(read(F.col("a"))).alias("n")).collect()
        assert [r.n for r in rows] == [0] * 6


# ---- reports


def test_sample_report_file(spark, tmp_path):
    """The golden path on a file: no banned phrase, no address twice, every section."""
    item = lambda n, t: {"title": t, "text": f"We lose hours to {t.lower()}.", "url": f"http://p/{n}"}
    data = {
        "date": DAY, "clusters": [{"id": "1", "title": "Builds fail without a reason", "summary": "Logs are cut.", "persona": "Platform teams", "why_matters": "Hours lost.", "size": 9, "score": 0.6, "items": [item(1, "Cut logs"), item(2, "Red builds")]}, {"id": "2", "title": "Nothing", "items": []}],
        "catalysts": [{"title": "Api limits change", "summary": "A deadline is near.", "interests": ["a", "b"], "problems_created": "Migration of many old clients now", "source_urls": ["http://n/1"]}], "wildcard": None,
    }
    (tmp_path / "s.json").write_text(json.dumps(data))
    md = report.sample_report(report.read_sample(spark, str(tmp_path / "s.json")), "Signals").first().markdown
    assert md.startswith("# Signals — 2024-02-03\n\n" + render.INTRO) and not any(p in md.lower() for p in lexicons.BANNED) and "evidence" in render.INTRO.lower() or "claim" in render.INTRO.lower()
    urls = [w for line in md.split("\n") for w in line.split() if w.startswith("http")]
    assert sorted(urls) == ["http://n/1", "http://p/1", "http://p/2"]
    assert "Today clusters around: Builds fail without a reason, Nothing, Api limits change." in md and "**Impact:** High" in md and "**Signal strength:** Med" in md and "*(None this time.)*" in md
    assert md.rstrip("\n").split("\n")[-1] == "One line I'd bet on: Unclear from evidence."  # the catalyst's


def test_report_round_trip_and_mail(spark):
    card = lambda title: (title, "Teams lose hours each week when gateways drop calls", "Calls & <b> vanish.", "Backend teams", [("two `words`", "http://p", "http://c")], "Platform leads", "", ["Hours lost", "more"], ["now"], ("icp", "a **small** cli", "", "forums", "none"), "high", "none left")
    rows = spark.createDataFrame([("2024-02-03", 0, card("First can fail"), True, ["w"], []), ("2024-02-03", 1, card("Second # can fail"), True, [], []), ("2024-02-03", 2, card("Third"), False, [], ["bad"]), ("2024-02-04", 0, card("Only one"), True, [], [])], f"date string, ordinal int, card struct<{validate_schema()}>, accepted boolean, warnings array<string>, errors array<string>")
    md = {r.date: r.markdown for r in report.assemble("Signals", rows).collect()}
    parsed = spark.createDataFrame(list(md.items()), "d string, md string").select("d", render.parse_report(F.col("md")).alias("r")).withColumn("html", render.issue_html(F.col("r"), "http://view?x=1", "http://leave"))
    got = {r.d: r for r in parsed.collect()}
    two, one = got["2024-02-03"].r, got["2024-02-04"].r
    assert [c.title for c in two.cards] == ["First can fail", "Second # can fail"] and two.rejects == ['**Card dropped** "Third": bad'] and not two.cards[0].is_draft and two.intro == render.INTRO
    assert two.cards[0].wedge.mvp == "a **small** cli" and two.cards[0].stakes == ["Hours lost", "more"] and two.cards[0].hook.startswith("Teams lose") and two.themes_line == "Today's themes: First can fail, Second # can fail."
    assert one.section_title == "## Draft / Needs more receipts" and one.cards[0].is_draft and one.one_bet == normalise.NO_DATA
    html = got["2024-02-03"].html
    assert "**" not in html and "##" not in html and "`" not in html and html.count("Read cluster") == 2 and "http://view?x=1&amp;card=1" in html
    assert "Calls &amp; &lt;b&gt; vanish." in html and "<strong>small</strong>" in html and "[Draft]" in got["2024-02-04"].html
    assert spark.range(1).select(render.parse_report(F.lit("no heading")).alias("r")).first().r is None


def validate_schema():
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in split_fields(validate.CARD))


def split_fields(ddl):
    """The fields of a schema, split at the commas outside of brackets."""
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def test_coherence_counts_all_snippets(spark):
    """An eleventh member's indicator counts, one over two snippets too, and a tag in two snippets."""
    said = [("eleven", i, 0, f"nothing {i}") for i in range(11)] + [("eleven", 11, 0, "XSS found"), ("over", 0, 0, "a sql"), ("over", 1, 0, "Injection now"), ("apart", 0, 0, "a sql"), ("apart", 1, 0, "now injection")]
    said += [("tags", 0, 0, "Deploys broke"), ("tags", 1, 0, "deploys broke"), ("once", 0, 0, "deploys broke"), ("twice", 0, 0, "deploy"), ("twice", 3, 1, "deploy"), ("none", 0, 0, "x")]
    tags = [("tags", " DEPLOY "), ("once", "deploy"), ("once", "broke"), ("twice", "deploy"), ("twice", ""), ("none", None), ("none", " ")]
    got = {r.cluster_id: (r.direct, r.hits, r.supported) for r in report.support(spark.createDataFrame(said, "cluster_id string, ordinal int, place int, value string"), spark.createDataFrame(tags, "cluster_id string, value string")).collect()}
    assert got == {"eleven": (1, 0, True), "over": (1, 0, True), "apart": (0, 0, False), "tags": (0, 2, True), "once": (0, 1, False), "twice": (0, 2, True), "none": (0, 0, False)}
    rows = spark.createDataFrame([("a", "s", True), ("b", "Unclear from evidence", True), ("c", "s", False)], "cluster_id string, summary string, supported boolean")
    assert [r.cluster_id for r in report.coherent(rows).collect()] == ["a"]


def test_lexicon_matching_is_literal(spark):
    words = ["a.b", "c++", "(d)", "e|f", "→", "can't"]
    rows = spark.createDataFrame([(t,) for t in ("axb", "A.B", "c+", "C++", "(d)", "e|f", "e", "x → y", "can't", "cant", None, "")], "t string")
    assert [r.x for r in rows.select(text.contains_any(F.col("t"), words).alias("x")).collect()] == [False, True, False, True, True, True, False, True, True, False, False, False]


def test_feeds_of_a_batch_are_parsed_in_small_parts(spark):
    """Of a batch of many feeds, or of long ones, only a bounded part is Python's objects at a time; a feed longer than that stays whole."""
    import pyarrow as pa

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    feed = lambda text: f"<rss><channel><item><title>{text}</title></item></channel></rss>".encode()
    contents = [feed("a")] * 1000 + [None] + [feed("b" * 1_500_000)] * 5 + [feed("c" * 6_000_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(contents))]), pa.array(contents, pa.binary())], ["a", "c"])
    with_none = pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.binary())], ["a", "c"])
    out = list(feeds.parse_feeds(Rows())([with_none, batch]))
    assert max(b.num_rows for b in out) <= 256 and max(b.nbytes for b in out if b.num_rows > 1) < 5_000_000
    titles = [t for b in out for t in b.column("title").to_pylist()]
    assert titles == ["a"] * 1000 + [None] + ["b" * 1_500_000] * 5 + ["c" * 6_000_000] and sum(e is not None for b in out for e in b.column("error").to_pylist()) == 1
