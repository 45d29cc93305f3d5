"""Prompts for a model, as Column expressions over cut payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import render
from .text import first_n, nz

_JSON = "Answer with valid JSON only, without markdown. Use nothing that the texts below do not say.\n"


def _cut(c: Column, n: int) -> Column:
    return F.substring(nz(c, ""), 1, n)


def _list(a: Column, n: int) -> Column:
    return F.concat(F.lit("["), F.array_join(first_n(F.coalesce(a, F.array().cast("array<string>")), n), ", "), F.lit("]"))


def _numbered(a: Column, n: int, line) -> Column:
    return F.array_join(F.transform(first_n(a, n), line), "\n")


def classify(title: Column, body: Column) -> Column:
    """For one post: label, scores, evidence, tags."""
    task = "Classify this post: label (PAIN, DISCUSSION, NEWS or OTHER), confidence, audience_fit, pain_intensity, actionability (0 to 1), evidence_spans, topic_tags, claim_anchors (verbatim, at most 12 words each), exclude_reason.\n"
    return F.concat(F.lit(_JSON + task), F.substring(F.concat(F.lit("Title: "), _cut(title, 500), F.lit("\n\nBody: "), _cut(body, 8000)), 1, 6000))


def editor(candidates: Column) -> Column:
    """For up to fifty candidates: which to feature."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    line = lambda c: F.concat(F.lit("id="), c["id"], F.lit(" title="), _cut(c["title"], 80), F.lit(" url="), nz(c["url"], ""), F.lit(" label="), nz(c["label"], ""), F.lit(" scores="), F.concat_ws("/", *[number(c[k]) for k in ("audience_fit", "pain_intensity", "actionability")]), F.lit(" evidence="), _list(c["evidence_spans"], 2))
    return F.concat(F.lit(_JSON + "Select posts: featured_pain_ids, secondary_pain_ids, catalyst_ids, rejects (id, reason).\n"), F.substring(_numbered(candidates, 50, line), 1, 12_000))


def cluster(members: Column) -> Column:
    """For the first fifteen members of a cluster: its write-up."""
    line = lambda m: F.concat(nz(m["title"], ""), F.lit("\n"), _cut(m["text"], 400))
    return F.concat(F.lit(_JSON + "Write up these posts: title, moment_of_pain, summary, persona, stakes, what_people_do_now, example_urls. Without two posts that agree the title is Insufficient evidence.\n"), F.substring(_numbered(members, 15, line), 1, 12_000))


def rename(title: Column, snippets: Column, wanted: str) -> Column:
    """For a title that its snippets don't support, or that names no failure."""
    return F.concat(F.lit(_JSON + f"Propose new_title, {wanted}.\nTitle: "), nz(title, ""), F.lit("\n"), F.substring(_numbered(snippets, 10, lambda s: F.concat(F.lit("- "), s)), 1, 4000))


def news(items: Column, excluded: list[str]) -> Column:
    """For up to thirty news items: catalysts."""
    line = lambda x: F.concat(F.lit("Title: "), nz(x["title"], ""), F.lit("\nURL: "), nz(x["url"], ""), F.lit("\nText: "), _cut(nz(x["text"], nz(x["title"], "")), 500))
    task = f"List catalysts: title, topic_tags, what_changed, who_feels_it, problems_created, opportunity_wedge, confidence, source_urls, connects_to. Leave out {', '.join(excluded)}.\n"
    return F.concat(F.lit(_JSON + task), F.substring(F.array_join(F.transform(first_n(items, 30), line), "\n\n"), 1, 15_000))


def gate(pain: Column, catalysts: Column) -> Column:
    """For up to twenty clusters and fifteen catalysts: those that can become cards."""
    number = lambda i: i.cast("string")
    one = F.transform(first_n(pain, 20), lambda c, i: F.concat(F.lit("[PAIN "), number(i), F.lit("] title="), nz(c["title"], ""), F.lit(" summary="), _cut(c["summary"], 200), F.lit(" tags="), _list(c["topic_tags"], 5), F.lit(" snippets="), _list(c["snippets"], 3)))
    two = F.transform(first_n(catalysts, 15), lambda c, i: F.concat(F.lit("[CATALYST "), number(i), F.lit("] title="), nz(c["title"], ""), F.lit(" changed="), _cut(c["what_changed"], 150), F.lit(" tags="), _list(c["topic_tags"], 5), F.lit(" wedge="), _cut(c["opportunity_wedge"], 150)))
    return F.concat(F.lit(_JSON + "Select what has a buyer, a blocked step and a small product: selected_pain_indices, selected_catalyst_indices, rejects (kind, index, reason).\n"), F.substring(F.array_join(F.concat(one, two), "\n"), 1, 14_000))


def compose(pain: Column, catalysts: Column) -> Column:
    """For up to fifteen clusters and catalysts each: cards."""
    one = lambda c: F.concat(F.lit("[Pain] title="), nz(c["title"], ""), F.lit(" summary="), _cut(c["summary"], 300), F.lit("\nEvidence:\n"), render.prompt_bullets(c["bullets"]))
    two = lambda c: F.concat(F.lit("[Catalyst] title="), nz(c["title"], ""), F.lit(" changed="), _cut(c["what_changed"], 200), F.lit(" tags="), _list(c["topic_tags"], 5), F.lit(" urls="), _list(c["source_urls"], 3))
    task = "Write cards: title, hook, problem, who_is_affected, evidence (quote, post_url, comment_url of those below), who_pays, why_existing_tools_fail, stakes, why_now, wedge (icp, mvp, why_they_pay, first_channel, anti_feature), confidence, kill_criteria.\n"
    return F.concat(F.lit(_JSON + task), F.substring(_numbered(pain, 15, one), 1, 12_000), F.lit("\n"), F.substring(_numbered(catalysts, 15, two), 1, 6000))


def bet(cards: Column) -> Column:
    """For up to five cards: one prediction."""
    line = lambda c: F.concat(F.lit("Card: "), nz(c["title"], ""), F.lit("\nProblem: "), nz(c["problem"], ""))
    return F.concat(F.lit("State one trend in a single sentence.\n"), F.substring(_numbered(cards, 5, line), 1, 3000))


_ITEM_KEYS = "hook, explanation, why_bullets, who, wedge, evidence_snippets, links, strength_or_impact"


def rewrite(kind: Column, draft: Column, evidence: Column, strength: Column) -> Column:
    """For one draft and its evidence: a short item."""
    task = f"Write one item with the keys {_ITEM_KEYS}: a hook of 8 to 14 words, up to three why_bullets, evidence_snippets of at most 12 words and links taken from those below, at most three of each, 120 words in all. Mark what you infer as likely. Leave out phrases that only announce, such as 'this highlights'.\n"
    lines = [F.concat(F.lit(f"{k}: "), nz(draft[k], "")) for k in ("title", "summary", "persona", "why_matters")]
    listed = lambda a, n: F.array_join(F.transform(first_n(a, n), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit(_JSON + task + "Kind: "), kind, F.lit(" strength_or_impact: "), strength, F.lit("\n"), F.concat_ws("\n", *lines), F.lit("\nEvidence:\n"), listed(evidence["snippets"], 5), F.lit("\nLinks:\n"), listed(evidence["links"], 3))


def repair_item(asked: Column, answer: Column, errors: Column) -> Column:
    """For an item that breaks rules: the same again, without the faults."""
    return F.concat(F.lit("Your JSON breaks these rules: "), F.array_join(errors, "; "), F.lit(f". Answer with valid JSON only, with the keys {_ITEM_KEYS}.\nYour answer was:\n"), answer, F.lit("\nThe task was:\n"), asked)
