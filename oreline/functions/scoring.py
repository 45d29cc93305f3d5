"""Scores, penalties, gates and grades as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import contains_any, count_contained, count_matched, n_words


def unit(c: Column) -> Column:
    """Clamped to 0..1; null is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def pain_heuristic(text: Column, title: Column | None = None, patterns: list[str] = L.PAIN_PATTERNS) -> Column:
    """0.15 a matching pattern, 0.2 for a question mark, at most 1; blank text scores 0."""
    body = F.coalesce(text, F.lit(""))
    both = body if title is None else F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n"), body)).otherwise(body)
    score = F.least(F.lit(1.0), count_matched(both, patterns) * 0.15 + F.when(F.contains(both, F.lit("?")), 0.2).otherwise(0.0))
    return F.when(F.regexp_like(both, F.lit(r"[^\s\p{Z}]")), score).otherwise(0.0)


def combined_pain(heuristic: Column, label: Column, confidence: Column) -> Column:
    """Half the heuristic, and a share of the confidence that the label decides; two decimals."""
    share = F.when(label == "PAIN", 0.5).when(label == "DISCUSSION", 0.3).otherwise(0.0)
    return F.round(0.5 * heuristic + share * confidence.cast("double"), 6).cast("decimal(5,2)")


def noise_penalty(title: Column, label: Column, source: Column, spans: Column, reason: Column) -> Column:
    show = contains_any(title, ["show hn"]) & (label != "PAIN")
    feed = (F.lower(F.coalesce(source, F.lit(""))) == "rss") & (F.coalesce(F.size(spans), F.lit(0)) <= 0)
    out = F.coalesce(reason, F.lit("")) != ""
    return F.when(show, L.PENALTY_SHOW).otherwise(0.0) + F.when(feed, L.PENALTY_FEED).otherwise(0.0) + F.when(out, L.PENALTY_EXCLUDED).otherwise(0.0)


def signal_score(audience_fit: Column, pain_intensity: Column, actionability: Column, confidence: Column, penalty: Column) -> Column:
    parts = {"audience_fit": audience_fit, "pain_intensity": pain_intensity, "actionability": actionability, "confidence": confidence}
    return F.greatest(F.lit(0.0), sum((w * unit(parts[k]) for k, w in L.WEIGHTS.items()), F.lit(0.0)) - penalty)


def passes_filter(label: Column, audience_fit: Column, pain_intensity: Column, actionability: Column, confidence: Column) -> Column:
    """Scores that are all null pass; a single null counts as 0.  Compared as decimals."""
    at_least = lambda c, x: F.coalesce(c.cast("decimal(4,3)"), F.lit(0).cast("decimal(4,3)")) >= F.lit(str(x)).cast("decimal(4,3)")
    none = audience_fit.isNull() & pain_intensity.isNull() & actionability.isNull()
    good = at_least(audience_fit, L.MIN_AUDIENCE) & (at_least(pain_intensity, L.MIN_PAIN) | at_least(actionability, L.MIN_ACTION))
    return F.coalesce(label.isin("PAIN", "DISCUSSION"), F.lit(False)) & at_least(confidence, L.MIN_CONFIDENCE) & (none | good)


def comment_score(text: Column, lexicon: list[str] = L.COMMENT_WORDS) -> Column:
    return count_contained(text, lexicon)


def span_shows_pain(spans: Column, lexicon: list[str] = L.SPAN_WORDS) -> Column:
    return contains_any(F.array_join(spans, " "), lexicon)


def signal_strength(size: Column, pain: Column, confidence: Column) -> Column:
    high = (size >= 5) & ((pain >= 0.5) | (confidence >= 0.7))
    return F.when(high, "High").when((size >= 2) | (pain >= 0.4) | (confidence >= 0.5), "Med").otherwise("Low")


def impact(interests: Column, urls: Column, urgent: Column) -> Column:
    return F.when(((interests >= 2) & (urls >= 1)) | urgent, "High").when((interests >= 1) | (urls >= 2), "Med").otherwise("Low")


def is_urgent(text: Column, lexicon: list[str] = L.URGENCY) -> Column:
    return contains_any(text, lexicon)


def _grade(c: Column) -> Column:
    return F.when(c == "Low", 0.2).when(c == "Med", 0.5).when(c == "High", 0.8).otherwise(0.4)


def buildability_pain(strength: Column, who: Column, wedge: Column) -> Column:
    return F.least(F.lit(1.0), _grade(strength) + F.when(n_words(who) >= 2, 0.1).otherwise(0.0) + F.when(n_words(wedge) >= 5, 0.1).otherwise(0.0))


def buildability_catalyst(grade: Column, problems: Column) -> Column:
    return F.least(F.lit(1.0), _grade(grade) + F.when(n_words(problems) >= 5, 0.15).otherwise(0.0))
