"""Evidence: snippets, their comments, coherence with topics, bundles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import contains_any, count_contained, distinct_ignoring_case, first_n, first_words, let, n_words, sentences, strip

NONE = "array<string>"


def snippets(title: Column, text: Column, comments: Column | None = None, most: int = 4, lexicon: list[str] = L.PAIN_WORDS) -> Column:
    """Up to ``most`` beginnings of twelve words: the title's if it shows pain, then those of sentences of three words or more that do; else of title or text."""
    head, body = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    whole = F.concat(head, F.lit("\n\n"), body)
    if comments is not None:
        more = F.transform(F.filter(F.coalesce(comments, F.array().cast(NONE)), lambda c: F.coalesce(c, F.lit("")) != ""), lambda c: F.concat(F.lit("\n\n"), F.substring(c, 1, 2000)))
        whole = F.concat(whole, F.array_join(more, ""))
    own = F.when(contains_any(head, lexicon), F.array(first_words(head))).otherwise(F.array().cast(NONE))
    said = F.filter(F.transform(sentences(whole, lexicon), lambda s: first_words(s)), lambda s: n_words(s) >= 3)
    found = distinct_ignoring_case(F.concat(own, said), most)
    fallback = first_words(F.when(head != "", head).otherwise(body))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(let(fallback, lambda y: F.when(y != "", F.array(y)).otherwise(F.array().cast(NONE)))))


def keyword_hits(evidence: Column, tags: Column) -> Column:
    """Snippets that hold a topic tag as a substring."""
    known = F.filter(F.transform(F.coalesce(tags, F.array().cast(NONE)), lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.size(F.filter(F.coalesce(evidence, F.array().cast(NONE)), lambda s: F.exists(known, lambda t: F.contains(F.lower(s), t))))


def indicator_hits(evidence: Column, lexicon: list[str] = L.DIRECT_INDICATORS) -> Column:
    """Indicators that the snippets, joined, hold."""
    return count_contained(F.array_join(F.coalesce(evidence, F.array().cast(NONE)), " ", ""), lexicon)


def coherence(tags: Column, evidence: Column) -> Column:
    """struct(passed, reason): one indicator, or two snippets with a tag."""
    direct, hits = indicator_hits(evidence), keyword_hits(evidence, tags)
    count = lambda c: c.cast("string")
    reason = (
        F.when(direct >= 1, F.concat(F.lit("direct_indicator_hits="), count(direct)))
        .when(hits >= 2, F.concat(F.lit("snippet_keyword_hits="), count(hits), F.lit(" across topic_tags")))
        .otherwise(F.concat(F.lit("insufficient support: snippet_keyword_hits="), count(hits), F.lit(" (need >=2), direct_indicator_hits="), count(direct), F.lit(" (need >=1)")))
    )
    return F.struct(((direct >= 1) | (hits >= 2)).alias("passed"), reason.alias("reason"))


def matched_comment(snippet: Column, all_snippets: Column, comments: Column) -> Column:
    """The last comment whose first matching snippet this is; null if none."""
    s = strip(snippet)

    def says(c: Column, x: Column) -> Column:
        body, y = strip(c["text"]), strip(x)
        return (y != "") & (n_words(y) <= 12) & (body != "") & (F.contains(body, y) | ((F.length(y) >= 8) & F.contains(F.lower(body), F.lower(y))))

    claims = F.filter(comments, lambda c: strip(F.get(F.filter(all_snippets, lambda x: says(c, x)), F.lit(0))) == s)
    return F.get(claims, F.size(claims) - 1)


def bullets(item: Column) -> Column:
    """Evidence bullets of an item struct (source, source_id, url, evidence_snippets, comments)."""
    kept = F.coalesce(item["evidence_snippets"], F.array().cast(NONE))
    post = F.coalesce(item["source_id"], F.lit(""))
    # Fixed value: the address of a post.
    url = F.when(F.coalesce(item["url"], F.lit("")) != "", item["url"]).when(post != "", F.concat(F.lit("https://news.ycombinator.com/item?id="), post)).otherwise("")
    threaded = (item["source"] == "hn") & (post != "")
    chosen = F.filter(F.when(threaded, first_n(kept, 5)).otherwise(first_n(kept, 3)), lambda s: strip(s) != "")

    def bullet(s: Column) -> Column:
        c = F.when(threaded, matched_comment(s, kept, item["comments"]))
        link = F.coalesce(F.nullif(c["post_url"], F.lit("")), url)
        return F.struct(F.substring(strip(s), 1, 200).alias("quote"), post.alias("post_id"), link.alias("post_url"), c["comment_id"].alias("comment_id"), c["comment_url"].alias("comment_url"))

    return F.transform(chosen, bullet)


def bundle(items: Column, most: int = 3, links: int = 3) -> Column:
    """struct(snippets, links) of a list of (url, title, text, evidence_snippets): stored snippets of twelve words or fewer, topped up from titles and texts.

    Items are read in order, and their links with them, until enough snippets are found.
    """
    some = first_n(items, 15)
    blank = F.array().cast(NONE)
    add = lambda a, s, ok: F.when(ok & (s != "") & ~F.array_contains(a, s), F.array_append(a, s)).otherwise(a)

    def stored(state: Column, x: Column) -> Column:
        u = F.coalesce(x["url"], F.lit(""))
        own = F.aggregate(F.coalesce(x["evidence_snippets"], blank), state["s"], lambda a, s: add(a, strip(s), (F.size(a) < most) & (n_words(s) <= 12)))
        now = F.struct(own.alias("s"), add(state["l"], u, F.lit(True)).alias("l"))
        return F.when(F.size(state["s"]) >= most, state).otherwise(now)

    found = F.aggregate(some, F.struct(blank.alias("s"), blank.alias("l")), stored)
    topped = F.aggregate(some, found["s"], lambda a, x: add(add(a, first_words(x["title"]), F.lit(True)), first_words(F.substring(x["text"], 1, 200)), F.size(add(a, first_words(x["title"]), F.lit(True))) < most))
    chosen = F.when(F.size(found["s"]) < most, topped).otherwise(found["s"])
    return F.struct(first_n(chosen, most).alias("snippets"), first_n(found["l"], links).alias("links"))


def catalyst_bundle(title: Column, summary: Column, urls: Column) -> Column:
    heads = F.filter(F.array(first_words(title), first_words(summary)), lambda s: s != "")
    return F.struct(heads.alias("snippets"), first_n(F.coalesce(urls, F.array().cast(NONE)), 3).alias("links"))
