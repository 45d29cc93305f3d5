"""A whole day: items in, a report out, with a model whose answers are scripted."""

import json
import re

import pytest
from pyspark.sql import functions as F

from oreline.functions import lexicons, prompts
from oreline.operators import day
from oreline.operators.tables import Tables

from .test_engine import DAY, checkpoints, items  # noqa: F401


class Script:
    """Answers by the task that a prompt names."""

    def generate(self, asked):
        return [self.one(p) for p in asked]

    def one(self, p):
        if "Classify this post" in p:
            news = "Body: News" in p
            return json.dumps({"label": "NEWS" if news else "PAIN", "confidence": 0.9, "audience_fit": 0.9, "pain_intensity": 0.8, "actionability": 0.7, "topic_tags": ["deploy"], "evidence_spans": ["deploy broke"]})
        if "Select posts" in p:
            return json.dumps({"featured_pain_ids": re.findall(r"id=([0-9a-f]{64})", p), "rejects": []})
        if "Write up these posts" in p:
            return json.dumps({"title": "Deploys break", "summary": "Deploys break often.", "persona": "Platform teams", "stakes": ["time"], "example_urls": []})
        if "Propose new_title" in p:
            return '{"new_title": "Silent deploys can break production overnight"}'
        if "List catalysts" in p:
            return json.dumps([{"title": "Runner limits change", "what_changed": "Limits change.", "problems_created": ["a", "b"], "opportunity_wedge": "Start small", "confidence": 0.7, "topic_tags": ["ci"], "source_urls": ["http://news"]}])
        if "Select what has a buyer" in p:
            return json.dumps({"selected_pain_indices": [0, 7], "selected_catalyst_indices": [0], "rejects": [{"kind": "catalyst", "index": 3, "reason": "news_only"}]})
        if "Write cards" in p:
            url = re.search(r"Post: (http\S+)", p).group(1)
            card = {
                "title": "Silent deploys can break production", "hook": "Teams lose hours each week when deploys fail silently", "problem": "Deploys fail.", "who_is_affected": "Platform teams", "evidence": [{"quote": "deploy broke", "post_url": url, "comment_url": ""}], "who_pays": "Platform leads at startups",
                "stakes": ["Hours lost"], "why_now": ["now"], "wedge": {"icp": "icp", "mvp": "a small cli checker", "why_they_pay": "saves hours", "first_channel": "forums", "anti_feature": "no agents"}, "confidence": "high", "kill_criteria": "no users",
            }
            return json.dumps([card, card | {"title": "Odd links cannot be trusted", "evidence": [{"quote": "q", "post_url": "http://invented"}]}])
        return "Deploys will be checked like code.\nMore."

    def embed(self, texts):
        return [[float("deploy" in t), float("login" in t), 0.1] for t in texts]


@pytest.fixture
def filled(spark, tmp_path, checkpoints):  # noqa: F811
    t = Tables(spark, str(tmp_path / "t"))
    rows = [("hn", str(i), f"http://p/{i}", f"deploy broke {i}", f"I hate when a deploy broke again. The deploy failed {i} times.", i) for i in range(6)] + [("hn", "9", "http://p/9", "login fails", "cannot login, the deploy is stuck", 9), ("rss", "n", "http://news", "News", "News of limits", 3)]
    t.put_items(items(spark, rows))
    return t


def test_a_day(spark, filled, tmp_path):
    day.analyze(filled, DAY, Script)
    labels = {r.label for r in filled.read("item_labels").collect()}
    assert labels == {"PAIN", "NEWS"} and filled.read("raw_items").where("size(evidence_snippets) > 0").count() == 7
    clusters = filled.clusters_of(DAY).collect()
    assert sum(c["size"] for c in clusters) == 7 and all(c.title and len(c.example_urls) <= 5 for c in clusters) and filled.read("embeddings").count() == 7
    day.run(filled, DAY, Script, "Signals", str(tmp_path / "md"))
    assert {c.title for c in filled.clusters_of(DAY).collect()} == {"Deploys break"} and [c.title for c in filled.catalysts_of(DAY).collect()] == ["Runner limits change"]
    md = filled.report_of(DAY).first().markdown
    assert md.startswith(f"# Signals — {DAY}") and "### **Silent deploys can break production**" in md and "One bet: Deploys will be checked like code.\n" in md
    # one card is left, so the section is a draft; the other cites a link that was not given
    assert "## Draft / Needs more receipts" in md and '- **Card dropped** "Odd links cannot be trusted": evidence contains invented post link' in md and "- **catalyst** index 3: news_only" in md
    assert "comment-level evidence" in md and "**Confidence:** low" in md
    code, issue = filled.report_status(DAY)
    assert code == 200 and len(issue.cards) == 1 and len(issue.rejects) == 2
    # again: the day is replaced, not added to
    day.run(filled, DAY, Script, "Signals")
    assert filled.report_of(DAY).count() == 1 and filled.catalysts_of(DAY).count() == 1


class Silent:
    def generate(self, asked):
        raise ValueError("no model")

    embed = generate


def test_a_day_without_a_model(spark, filled):
    """Every fallback at once: no labels, so no candidates, no clusters, no cards."""
    day.analyze(filled, DAY, Silent)
    assert {(r.label, r.exclude_reason) for r in filled.read("item_labels").collect()} == {("OTHER", "error")} and filled.clusters_of(DAY).count() == 0
    day.run(filled, DAY, Silent, "Signals")
    md = filled.report_of(DAY).first().markdown
    assert "## Draft / Needs more receipts" in md and "One bet: Worth exploring: re-run with more data." in md and "Rejects" not in md


def test_prompts_are_cut(spark):
    long = F.repeat(F.lit("x"), 20_000)
    row = spark.range(1).select(
        prompts.classify(long, long).alias("a"), prompts.news(F.array_repeat(F.struct(long.alias("title"), F.lit("u").alias("url"), long.alias("text")), 40), lexicons.EXCLUDED).alias("b"), prompts.rename(F.lit("t"), F.array_repeat(long, 3), "short").alias("c")
    ).first()
    assert len(row.a) < 6500 and len(row.b) < 15_600 and len(row.c) < 4300 and all(t in row.b for t in lexicons.EXCLUDED)
