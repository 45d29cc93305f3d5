"""Normalisers of model answers: JSON text in, typed values out, with the fallback of each call.

A field that cannot be read takes its default; an answer that is no JSON of
the expected kind takes the fallback.  List elements that are not objects are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import render, validate
from .answers import text_of, texts_of, with_object
from .scoring import unit
from .text import first_n, let, nz, strip

_NONE = "array<string>"
# Texts that stand in for missing ones.
UNCLEAR, NO_DATA, NO_TITLE, NO_TEAM = "Unclear from evidence.", "Worth exploring: re-run with more data.", "Pain signal", "Engineering teams"
LIMITED = "Limited comment-level evidence; confidence capped at low."

CATALYSTS = (
    "struct<title: string, topic_tags: array<string>, what_changed: string, who_feels_it: string, problems_created: string, opportunity_wedge: string, "
    "confidence: string, source_urls: array<string>, summary: string, connects_to: string>"
)
SUMMARY = "title string, moment_of_pain string, summary string, persona string, stakes array<string>, what_people_do_now string, example_urls array<string>"
CARDS = (
    "struct<title: string, hook: string, problem: string, who_is_affected: string, evidence: array<string>, who_pays: string, why_existing_tools_fail: string, stakes: array<string>, why_now: array<string>, "
    "wedge: struct<icp: string, mvp: string, why_they_pay: string, first_channel: string, anti_feature: string>, confidence: string, kill_criteria: string>"
)
_SIGNAL = "struct<claim: string, evidence_snippets: array<string>, links: array<string>>"
IDEAS = f"struct<idea_title: string, hook: string, what_happened: string, pain_signal: {_SIGNAL}, catalyst_signal: {_SIGNAL}, why_now: array<string>, wedge: string, confidence: string, inference: string>"
ITEM = "hook string, explanation string, why_bullets array<string>, who string, wedge string, evidence_snippets array<string>, links array<string>, strength_or_impact string"


def unfenced(c: Column) -> Column:
    """An answer without the fences around a block of code."""
    return strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def _is_object(raw: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.startswith(raw, F.lit("{")) & F.get_json_object(raw, "$").isNotNull()


def _cut(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def _tidy(c: Column, n: int) -> Column:
    return _cut(strip(F.coalesce(c, F.lit(""))), n)


def _list(a: Column, n: int) -> Column:
    return first_n(F.filter(F.coalesce(a, F.array().cast(_NONE)), lambda s: s.isNotNull()), n)


def _share(c: Column) -> Column:
    """A number as text, within 0 to 1; one half if it is none."""
    return F.when(c.try_cast("double").isNull(), 0.5).otherwise(unit(c.try_cast("double")))


def sentence(c: Column, n: int = 300) -> Column:
    """A wedge with a full stop at its end."""
    return let(strip(nz(c, UNCLEAR)), lambda text: F.substring(F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), 1, n))


def strings_of(c: Column, n: int = 5) -> Column:
    """The strings of a JSON list given as text; any other text is a list of itself."""
    listed = F.startswith(strip(c), F.lit("["))
    return F.when(listed, _list(F.from_json(c, _NONE), n)).when(nz(c, "") != "", F.array(c)).otherwise(F.array().cast(_NONE))


def problems_text(problems: Column, n: int = 500) -> Column:
    """Problems as one text."""
    return F.substring(F.array_join(F.coalesce(problems, F.array().cast(_NONE)), " "), 1, n)


def _objects(answer: Column, schema: str, n: int) -> Column:
    """The objects among the first n elements of an answer that is a list; each is read by itself, so a bad one spoils no other."""
    texts = let(unfenced(answer), lambda raw: F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, _NONE)))
    objects = F.filter(first_n(F.coalesce(texts, F.array().cast(_NONE)), n), lambda x: F.coalesce(F.startswith(x, F.lit("{")), F.lit(False)))
    return F.transform(objects, lambda x: F.from_json(x, schema))


def catalysts(answer: Column, n: int = 7) -> Column:
    """Up to n catalysts of an answer; none if it is no list."""

    def one(x: Column) -> Column:
        told = F.coalesce(F.nullif(x["what_changed"], F.lit("")), x["summary"])
        return F.struct(
            _cut(x["title"], 200).alias("title"), _list(x["topic_tags"], 5).alias("topic_tags"), _cut(x["what_changed"], 500).alias("what_changed"), _cut(x["who_feels_it"], 200).alias("who_feels_it"),
            strings_of(x["problems_created"]).alias("problems_created"), sentence(x["opportunity_wedge"]).alias("opportunity_wedge"), _share(x["confidence"]).alias("confidence"),
            _list(x["source_urls"], 3).alias("source_urls"), _cut(told, 800).alias("summary"), F.array().cast(_NONE).alias("interests"), F.nullif(_tidy(x["connects_to"], 300), F.lit("")).alias("connects_to"),
        )

    return F.transform(_objects(answer, CATALYSTS, n), one)


def cluster_summary(answer: Column, title: Column, summary: Column, persona: Column, why: Column, links: Column) -> Column:
    """The write-up of a cluster; without an object it keeps what it had, and without evidence its fields are blank."""
    none = F.lit("")
    kept = F.struct(
        nz(title, NO_TITLE).alias("title"), none.alias("moment_of_pain"), nz(summary, "").alias("summary"), nz(persona, "").alias("persona"), F.array().cast(_NONE).alias("stakes"), none.alias("what_people_do_now"),
        first_n(F.coalesce(links, F.array().cast(_NONE)), 5).alias("example_urls"), nz(why, "").alias("why_matters"),
    )

    def told(d: Column, named: Column, thin: Column) -> Column:
        urls = first_n(F.when(F.size(F.coalesce(d["example_urls"], F.array().cast(_NONE))) > 0, d["example_urls"]).otherwise(F.coalesce(links, F.array().cast(_NONE))), 5)
        blank = lambda c: F.when(thin, "").otherwise(c)
        stakes = F.coalesce(d["stakes"], F.array().cast(_NONE))
        return F.struct(
            named.alias("title"), blank(_cut(d["moment_of_pain"], 500)).alias("moment_of_pain"), blank(_cut(nz(d["summary"], nz(summary, "")), 1500)).alias("summary"), blank(_cut(nz(d["persona"], nz(persona, "")), 300)).alias("persona"),
            F.when(thin, F.array().cast(_NONE)).otherwise(_list(stakes, 5)).alias("stakes"), blank(_cut(d["what_people_do_now"], 300)).alias("what_people_do_now"), urls.alias("example_urls"),
            blank(nz(F.substring(F.array_join(stakes, " "), 1, 500), nz(why, ""))).alias("why_matters"),
        )

    def read(d: Column) -> Column:
        named = _cut(nz(d["title"], nz(title, NO_TITLE)), 200)
        return let(named, lambda t: let(F.contains(F.lower(t), F.lit("insufficient evidence")), lambda thin: told(d, t, thin)))

    # the answer is read once, however many of its fields are used
    return let(unfenced(answer), lambda raw: F.when(_is_object(raw), let(F.from_json(raw, SUMMARY), read)).otherwise(kept))


def gate_answer(answer: Column, n_pain: Column, n_catalysts: Column) -> Column:
    """struct(pain, catalysts, rejects): chosen positions within bounds, in the order given; the first 5 and 3 if the answer is no object.  Positions that are no numbers are left out."""
    first = lambda n, most: F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<struct<kind: string, index: string, reason: string>>")

    def read(v: Column) -> Column:
        numbers = lambda k: F.transform(F.coalesce(texts_of(v, k), F.array().cast(_NONE)), lambda x: x.try_cast("double").try_cast("int"))
        within = lambda k, n: F.filter(numbers(k), lambda i: i.isNotNull() & (i >= 0) & (i < n))
        each = F.coalesce(F.try_variant_get(v, "$.rejects", "array<variant>"), F.array().cast("array<variant>"))
        objects = F.filter(each, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
        rejects = F.transform(objects, lambda x: F.struct(*[text_of(x, k).alias(k) for k in ("kind", "index", "reason")]))
        return F.struct(within("selected_pain_indices", n_pain).alias("pain"), within("selected_catalyst_indices", n_catalysts).alias("catalysts"), rejects.alias("rejects"))

    return with_object(unfenced(answer), read, F.struct(first(n_pain, 5).alias("pain"), first(n_catalysts, 3).alias("catalysts"), none.alias("rejects")))


def picked(values: Column, positions: Column) -> Column:
    """The values at the positions, in their order; positions out of bounds are left out, repeated ones repeat."""
    return F.transform(F.filter(positions, lambda i: (i >= 0) & (i < F.size(values))), lambda i: F.get(values, i))


def new_title(answer: Column, title: Column, snippets: Column) -> Column:
    """The title an answer proposes; the old one without snippets, or if the answer holds none."""
    proposed = strip(F.get_json_object(unfenced(answer), "$.new_title"))
    return F.when(F.coalesce(F.size(snippets), F.lit(0)) > 0, nz(F.substring(proposed, 1, 200), title)).otherwise(title)


def evidence_entry(e: Column) -> Column:
    """struct(quote, post_url, comment_url) of an entry given as JSON text: an object, or a quote alone."""
    link = lambda u: F.nullif(strip(u), F.lit(""))
    read = lambda d: F.struct(_tidy(d["quote"], 200).alias("quote"), link(d["post_url"]).alias("post_url"), link(d["comment_url"]).alias("comment_url"))
    bare = F.struct(_tidy(e, 200).alias("quote"), F.lit(None).cast("string").alias("post_url"), F.lit(None).cast("string").alias("comment_url"))
    return F.when(F.startswith(strip(e), F.lit("{")), let(F.from_json(e, "quote string, post_url string, comment_url string"), read)).otherwise(bare)


def affected(who: Column, pays: Column, icp: Column) -> Column:
    """Who is affected; a missing or bare one is who pays, else the customer, else a general one."""
    own = F.when(F.lower(strip(who)).isin("developers", "developer"), None).otherwise(F.nullif(strip(who), F.lit("")))
    return F.substring(F.coalesce(own, F.nullif(pays, F.lit("")), F.nullif(icp, F.lit("")), F.lit(NO_TEAM)), 1, 300)


def cards(answer: Column, n: int = 5) -> Column:
    """Up to n cards (validate.CARD and card_warnings) of an answer, with confidence lowered where comment links are few."""

    def one(x: Column) -> Column:
        w = x["wedge"]
        wedge = F.struct(*[_tidy(w[k], m).alias(k) for k, m in (("icp", 300), ("mvp", 300), ("why_they_pay", 200), ("first_channel", 200), ("anti_feature", 200))])
        pays = _tidy(x["who_pays"], 200)
        said = F.lower(strip(nz(x["confidence"], "med")))
        listed = lambda a, m: F.transform(_list(a, 5), lambda s: _tidy(s, m))

        def whole(evidence: Column) -> Column:
            confidence = validate.lowered_confidence(F.when(said.isin("low", "med", "high"), said).otherwise("med"), evidence)
            few = F.when(validate.thread_links(evidence) < 2, F.array(F.lit(LIMITED))).otherwise(F.array().cast(_NONE))
            return F.struct(
                _cut(x["title"], 200).alias("title"), _cut(x["hook"], 500).alias("hook"), _cut(x["problem"], 500).alias("problem"), affected(x["who_is_affected"], pays, wedge["icp"]).alias("who_is_affected"), evidence.alias("evidence"),
                pays.alias("who_pays"), _tidy(x["why_existing_tools_fail"], 300).alias("why_existing_tools_fail"), listed(x["stakes"], 200).alias("stakes"), listed(x["why_now"], 300).alias("why_now"), wedge.alias("wedge"),
                confidence.alias("confidence"), _tidy(x["kill_criteria"], 300).alias("kill_criteria"), few.alias("card_warnings"),
            )

        return let(F.transform(_list(x["evidence"], 5), evidence_entry), whole)

    return F.transform(_objects(answer, CARDS, n), one)


def idea_cards(answer: Column, n: int = 5) -> Column:
    """Up to n idea cards of an answer; one that repeats a link of an earlier kept one is left out."""
    signal = lambda s: F.struct(_cut(s["claim"], 500).alias("claim"), _list(s["evidence_snippets"], 5).alias("evidence_snippets"), _list(s["links"], 3).alias("links"))

    def one(x: Column) -> Column:
        return F.struct(
            _cut(x["idea_title"], 200).alias("idea_title"), _cut(x["hook"], 500).alias("hook"), _cut(x["what_happened"], 800).alias("what_happened"), signal(x["pain_signal"]).alias("pain_signal"), signal(x["catalyst_signal"]).alias("catalyst_signal"),
            _list(x["why_now"], 3).alias("why_now"), sentence(x["wedge"]).alias("wedge"), _share(x["confidence"]).alias("confidence"), _cut(x["inference"], 400).alias("inference"),
        )

    def links(x: Column) -> Column:
        both = F.concat(*[F.coalesce(x[s]["links"], F.array().cast(_NONE)) for s in ("pain_signal", "catalyst_signal")])
        return F.filter(both, lambda u: F.coalesce(u, F.lit("")) != "")

    start = F.struct(F.array().cast(_NONE).alias("seen"), F.array().cast("array<int>").alias("kept"))

    def chosen(raw: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            known = lambda own: F.when(~F.arrays_overlap(own, state["seen"]), F.struct(F.array_union(state["seen"], own).alias("seen"), F.array_append(state["kept"], i).alias("kept"))).otherwise(state)
            return let(links(F.get(raw, i)), known)

        places = F.when(F.size(raw) > 0, F.sequence(F.lit(0), F.size(raw) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.aggregate(places, start, step)["kept"], lambda i: let(F.get(raw, i), one))

    # the objects are read once, however often the choice and the fields look at them
    return let(_objects(answer, IDEAS, n), chosen)


def bet_line(answer: Column, n_cards: Column) -> Column:
    """The first line of an answer; a general one without cards or without an answer."""
    line = F.substring(strip(F.get(F.split(strip(F.coalesce(answer, F.lit(""))), "\n"), F.lit(0))), 1, 300)
    return F.when((n_cards > 0) & (line != ""), line).otherwise(NO_DATA)


def item_answer(answer: Column, evidence: Column, strength: Column) -> Column:
    """The item that an answer is, with links of the evidence only; null if it is no JSON object."""
    grade = F.when(strength.isin("Low", "Med", "High"), strength).otherwise("Med")

    def read(d: Column) -> Column:
        own = first_n(F.filter(_list(d["links"], 1000), lambda u: F.array_contains(evidence["links"], u)), 3)
        many = lambda k: F.transform(_list(d[k], 3), strip)
        said = strip(nz(d["strength_or_impact"], ""))
        return F.struct(
            strip(nz(d["hook"], "")).alias("hook"), strip(nz(d["explanation"], "")).alias("explanation"), many("why_bullets").alias("why_bullets"), strip(nz(d["who"], "")).alias("who"), strip(nz(d["wedge"], "")).alias("wedge"),
            many("evidence_snippets").alias("evidence_snippets"), let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(first_n(evidence["links"], 3))).alias("links"), F.when(said.isin("Low", "Med", "High"), said).otherwise(grade).alias("strength_or_impact"),
        )

    return let(unfenced(answer), lambda raw: F.when(_is_object(raw), let(F.from_json(raw, ITEM), read)))


def template_item(answers: Column, draft: Column, evidence: Column, strength: Column) -> Column:
    """The first of the answers that is a valid item; else one made of the draft."""
    items = F.transform(answers, lambda a: item_answer(a, evidence, strength))
    valid = F.filter(items, lambda x: x.isNotNull() & (F.size(validate.item_errors(x)) == 0))
    return F.coalesce(F.get(valid, F.lit(0)), render.plain_item(draft, evidence, strength))
