"""Validators and repair of items and cards: rules as Column expressions that give arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import contains_any, first_n, let, messages, n_words, strip, words

CARD = (
    "title string, hook string, problem string, who_is_affected string, evidence array<struct<quote: string, post_url: string, comment_url: string>>, who_pays string, "
    "why_existing_tools_fail string, stakes array<string>, why_now array<string>, wedge struct<icp: string, mvp: string, why_they_pay: string, first_channel: string, anti_feature: string>, confidence string, kill_criteria string"
)
_WEDGE = ("icp", "why_they_pay", "first_channel", "anti_feature")


def _s(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _generic(c: Column) -> Column:
    return F.lower(_s(c)).isin("developers", "developer")


def names_failure(title: Column) -> Column:
    """Whether a title names a failure: a sign, a verb, or five words or more."""
    t = F.lower(_s(title))
    verbs = F.array(*[F.lit(v) for v in L.FAILURE_VERBS])
    verb = F.exists(words(t), lambda w: F.arrays_overlap(F.array(F.rtrim(w, F.lit("s")), F.rtrim(w, F.lit("ed")), F.rtrim(w, F.lit("ing"))), verbs))
    return (F.length(t) >= 5) & (contains_any(t, L.FAILURE_SIGNS) | verb | (n_words(t) >= 5))


def is_tangible(mvp: Column) -> Column:
    return (F.length(_s(mvp)) >= 10) & contains_any(mvp, L.TANGIBLE)


def names_buyer(c: Column) -> Column:
    return (F.length(_s(c)) >= 5) & ~_generic(c) & (F.size(F.filter(words(c), lambda w: F.length(w) > 1)) >= 2)


def has_stake(stakes: Column) -> Column:
    return F.coalesce(F.exists(stakes, lambda s: contains_any(s, L.STAKES)), F.lit(False))


# The texts of all messages in item_errors and card_errors, which reports show, in this order.


def item_errors(item: Column) -> Column:
    """Errors of an item struct (hook, explanation, why_bullets, who, wedge, evidence_snippets, links, strength_or_impact)."""
    total = n_words(item["hook"]) + n_words(item["explanation"]) + n_words(item["who"]) + n_words(item["wedge"]) + n_words(item["strength_or_impact"])
    for many in ("why_bullets", "evidence_snippets"):
        total = total + F.aggregate(item[many], F.lit(0), lambda a, s: a + n_words(s))
    long = F.filter(item["evidence_snippets"], lambda s: ~n_words(s).between(1, 12))
    hook = F.lower(item["hook"])
    blocks = F.concat(F.array(item["explanation"], item["who"], item["wedge"]), item["why_bullets"])
    return F.concat(
        F.when(total > 120, F.array(F.concat(F.lit("word_count_excluding_links="), total.cast("string"), F.lit(" > 120")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(item["links"]) > 3, F.array(F.concat(F.lit("links count "), F.size(item["links"]).cast("string"), F.lit(" > 3")))).otherwise(F.array().cast("array<string>")),
        messages((F.size(item["evidence_snippets"]) == 0, "evidence_snippets required"), (F.size(item["links"]) == 0, "at least one link required")),
        F.transform(long, lambda s: F.concat(F.lit("evidence snippet must be ≤12 words: '"), F.substring(s, 1, 50), F.lit("'"))),
        messages(
            (~n_words(item["hook"]).between(8, 14), "hook must be 8–14 words"),
            (F.startswith(hook, F.lit("this article")) | F.startswith(hook, F.lit("this post")), "hook must not start with 'This article' / 'This post'"),
            (~item["strength_or_impact"].isin("Low", "Med", "High"), "strength_or_impact must be Low, Med, or High"),
        ),
        F.transform(F.filter(blocks, lambda b: contains_any(b, L.BANNED)), lambda b: F.lit("banned phrase in content")),
    )


def card_errors(c: Column, allowed: Column) -> Column:
    """struct(hard, soft, warnings) of a card struct.  ``allowed`` are the known URLs; an empty list allows every URL.

    What the rules ask of a text is found out once and held beside it, as the rules use it several times.
    """
    none = F.array().cast("array<string>")
    closed = F.size(allowed) > 0
    banned = lambda *cols: contains_any(F.concat_ws("\n", *cols), L.CARD_BANNED)

    def entry(e: Column) -> Column:
        post, comment = _s(e["post_url"]), _s(e["comment_url"])
        return F.struct(post.alias("post"), comment.alias("comment"), F.array_contains(allowed, post).alias("post_known"), F.array_contains(allowed, comment).alias("comment_known"), _s(e["quote"]).alias("quote"), n_words(e["quote"]).alias("n"))

    evidence = F.transform(F.coalesce(first_n(c["evidence"], 10), F.array().cast("array<struct<quote: string, post_url: string, comment_url: string>>")), entry)
    confidence = F.lower(_s(F.when(F.coalesce(c["confidence"], F.lit("")) == "", "med").otherwise(c["confidence"])))
    texts = ("title", "hook", "problem", "who_pays", "kill_criteria", "who_is_affected")
    # texts first, then what is counted in them
    read = F.struct(*[_s(c[k]).alias(k) for k in texts], n_words(c["title"]).alias("n_title"), n_words(c["hook"]).alias("n_hook"), confidence.alias("confidence"), evidence.alias("evidence"), *[_s(c["wedge"][k]).alias(k) for k in ("icp", "mvp", *_WEDGE[1:])])

    def told(m: Column) -> Column:
        title, hook, found, pays, who, mvp = m["n_title"], m["n_hook"], m["evidence"], m["who_pays"], m["who_is_affected"], m["mvp"]
        empty, wedge = F.size(found) == 0, c["wedge"].isNotNull()
        posted = F.exists(found, lambda e: (e["post"] != "") & (~closed | e["post_known"]))
        invented = F.flatten(F.transform(found, lambda e: messages((closed & (e["post"] != "") & ~e["post_known"], "evidence contains invented post link"), (closed & (e["comment"] != "") & ~e["comment_known"], "evidence contains invented comment link"))))
        quotes = F.flatten(F.transform(found, lambda e: messages((e["quote"] == "", "evidence bullet missing quote"), (e["n"] > 12, "evidence quote must be ≤12 words"))))
        hard = F.concat(
            messages(
                (title == 0, "title required"), (title.between(4, 12) & ~names_failure(c["title"]), "title must imply failure mode"), (hook == 0, "hook required"),
                (m["problem"] == "", "problem required"), (empty, "evidence missing entirely"),
            ),
            invented,
            messages(
                (~empty & ~posted, "evidence has no post_url links"), (_generic(pays), "buyer/owner undefined (generic 'developers' with no role/team)"),
                (~wedge, "wedge must be object"), (wedge & (mvp == ""), "wedge.mvp required"), (m["kill_criteria"] == "", "kill_criteria required"),
                (banned(*[m[k] for k in texts[:5]]), "banned phrase in content"),
                (wedge & banned(*[m[k] for k in ("icp", "mvp", *_WEDGE[1:])]), "banned phrase in wedge"),
                (F.exists(F.coalesce(c["why_now"], none), lambda w: contains_any(w, L.CARD_BANNED)), "banned phrase in why_now"),
            ),
        )
        soft = F.concat(
            messages(
                ((title > 0) & ~title.between(4, 12), "title must be 4–12 words"), ((hook > 0) & ~hook.between(8, 14), "hook must be 8–14 words"), (who == "", "who_is_affected missing"),
                (_generic(who), "who_is_affected must name concrete roles or teams (not just 'developers')"),
            ),
            quotes,
            messages(
                (pays == "", "who_pays missing"), ((pays != "") & ~_generic(pays) & ~names_buyer(pays), "who_pays should include role + org type"),
                (~has_stake(c["stakes"]), "stakes must include at least one (time, reliability, security, money); proxy/estimate allowed if labeled"),
                ((mvp != "") & ~is_tangible(mvp), "wedge.mvp should include tangible artifact (scanner, diff, CLI, etc.)"),
                *[(wedge & (m[k] == ""), f"wedge.{k} missing") for k in _WEDGE],
                ((m["confidence"] != "") & ~m["confidence"].isin("low", "med", "high"), "confidence must be low|med|high"),
            ),
        )
        warnings = F.transform(F.filter(found, lambda e: e["comment"] == ""), lambda e: F.lit("comment link missing"))
        return F.struct(hard.alias("hard"), soft.alias("soft"), warnings.alias("warnings"))

    return let(read, told)


def repaired(c: Column) -> Column:
    """The card with a buyer inferred from its words, trimmed evidence, proxy stakes and no confidence above med."""
    t, p = F.lower(_s(c["title"])), F.lower(_s(c["problem"]))
    has = lambda x, *w: contains_any(x, list(w))
    # Buyers by topic.
    inferred = (
        F.when(has(t, "security", "vulnerability") | has(p, "security", "vuln"), "SecEng / AppSec teams at product companies")
        .when(has(t, "api", "call") | has(p, "api"), "Platform / backend teams at scale")
        .when(has(t, "offline", "private", "scan"), "Security and compliance teams in regulated orgs")
        .when(has(t, "ai", "code", "generated"), "Engineering leads and platform teams shipping AI-generated code")
        .when(_s(c["who_pays"]) != "", _s(c["who_pays"]))
        .otherwise("Platform / SRE teams at product companies")
    )
    clean = lambda u: F.nullif(_s(u), F.lit(""))
    evidence = F.transform(first_n(c["evidence"], 10), lambda e: F.struct(F.substring(_s(e["quote"]), 1, 200).alias("quote"), clean(e["post_url"]).alias("post_url"), clean(e["comment_url"]).alias("comment_url")))
    proxy = F.concat(F.array(*[F.lit(x) for x in L.PROXY_STAKES]), F.coalesce(first_n(c["stakes"], 3), F.array().cast("array<string>")))
    confidence = F.lower(_s(c["confidence"]))
    out = c.withField("who_pays", F.when(names_buyer(c["who_pays"]), c["who_pays"]).otherwise(inferred))
    out = out.withField("evidence", evidence).withField("stakes", F.when(has_stake(c["stakes"]), c["stakes"]).otherwise(proxy))
    return out.withField("confidence", F.when(confidence == "low", "low").otherwise("med"))


def comment_share(evidence: Column) -> Column:
    """The share of evidence with a comment link; 0 without evidence."""
    return F.when(F.size(evidence) > 0, F.size(F.filter(evidence, lambda e: _s(e["comment_url"]) != "")) / F.size(evidence)).otherwise(0.0)


def thread_links(evidence: Column) -> Column:
    # Fixed value: the part of an address that marks a comment's permalink.
    return F.size(F.filter(evidence, lambda e: F.contains(F.coalesce(e["comment_url"], F.lit("")), F.lit("news.ycombinator.com/item?id="))))


def lowered_confidence(confidence: Column, evidence: Column) -> Column:
    """One grade lower below 70 % comment links; low with fewer than two thread links."""
    step = F.when(confidence == "high", "med").when(confidence == "med", "low").otherwise(confidence)
    return F.when(thread_links(evidence) < 2, "low").when(comment_share(evidence) < 0.7, step).otherwise(confidence)
