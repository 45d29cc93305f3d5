"""Markdown and HTML of items, cards and reports, and the parser back, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import distinct_ignoring_case, first_n, first_words, let, n_words, nz, strip

# Fixed value: what the report says about itself.
INTRO = "This report distils repeated problems from public developer conversations and tech news. Every claim is tied to snippets and links; where evidence is thin, it says so."


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _lines(*parts: Column) -> Column:
    """Arrays of lines, one below the other."""
    return F.array_join(F.concat(*parts), "\n", "")


def _line(*parts) -> Column:
    return F.array(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def item_markdown(item: Column, kind: Column) -> Column:
    grade = F.when(kind == "catalyst", "**Impact:** ").otherwise("**Signal strength:** ")
    return _lines(
        _line("### **", item["hook"], "**"), _line(""), _line(item["explanation"]), _line(""), F.transform(item["why_bullets"], lambda b: F.concat(F.lit("- "), b)), _line(""),
        _line("**Who:** ", item["who"]), _line("**Possible wedge:** ", item["wedge"]), _line(grade, item["strength_or_impact"]), _line(""),
        _line("**Evidence:** ", F.array_join(first_n(item["evidence_snippets"], 3), "; ")), F.transform(F.filter(first_n(item["links"], 3), lambda u: u != ""), lambda u: F.concat(F.lit("- "), u)), _line(""),
    )


def bullet_text(e: Column) -> Column:
    link = lambda u: F.coalesce(F.nullif(strip(_z(u)), F.lit("")), F.lit("(none)"))
    return F.concat(F.lit('"'), strip(_z(e["quote"])), F.lit('" — Post: '), link(e["post_url"]), F.lit(" — Comment: "), link(e["comment_url"]))


def card_markdown(c: Column, warnings: Column, draft: Column) -> Column:
    listed = lambda name, a: _if(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(_line(name), F.transform(F.filter(first_n(a, 3), lambda s: s != ""), lambda s: F.concat(F.lit("- "), s)), _line("")))
    named = lambda name, x, *after: _if(strip(_z(x)) != "", F.concat(_line(f"**{name}:** ", strip(_z(x))), *after))
    w, confidence = c["wedge"], F.lower(F.coalesce(F.nullif(c["confidence"], F.lit("")), F.lit("med")))
    return _lines(
        _if(draft, F.concat(_line("*(Draft — needs more receipts)*"), _line(""))),
        _line("### **", F.coalesce(F.nullif(c["title"], F.lit("")), F.lit("Idea")), "**"), _line(""), _line(_z(c["hook"])), _line(""), _line("**Problem:** ", _z(c["problem"])), _line(""),
        named("Who is affected", c["who_is_affected"], _line("")),
        _if(F.coalesce(F.size(c["evidence"]), F.lit(0)) > 0, F.concat(_line("**Evidence:**"), F.transform(first_n(c["evidence"], 5), lambda e: F.concat(F.lit("- "), bullet_text(e))), _line(""))),
        _line("**Who pays:** ", _z(c["who_pays"])), named("Why existing tools fail", c["why_existing_tools_fail"]), listed("**Stakes:**", c["stakes"]), listed("**Why now:**", c["why_now"]),
        _if(w.isNotNull(), F.concat(_line("**Wedge:**"), *[_line(f"- {n}: ", _z(w[k])) for n, k in (("ICP", "icp"), ("MVP", "mvp"), ("Why they pay", "why_they_pay"), ("First channel", "first_channel"), ("Anti-feature", "anti_feature"))], _line(""))),
        _if(confidence.isin("low", "med", "high"), _line("**Confidence:** ", confidence)), _line(""), _if(_z(c["kill_criteria"]) != "", _line("**Kill criteria:** ", c["kill_criteria"])),
        _if(F.size(warnings) > 0, F.concat(_line(""), _line("**Warnings:** ", F.array_join(warnings, "; ")))), _line(""),
    )


def themes(titles: Column, n: int = 3) -> Column:
    known = F.filter(F.transform(first_n(F.filter(titles, lambda t: t != ""), n), strip), lambda t: t != "")
    return F.when(F.size(known) > 0, F.concat(F.lit("Today's themes: "), F.array_join(known, ", "), F.lit("."))).otherwise("")


def pattern_language(clusters: Column, catalysts: Column, most: int = 5) -> Column:
    """One line of up to five themes, of the first five clusters and three catalysts."""
    clean = lambda a, n: F.filter(F.transform(first_n(a, n), lambda t: strip(_z(t))), lambda t: t != "")
    known = first_n(distinct_ignoring_case(F.concat(clean(clusters, 5), clean(catalysts, 3))), most)
    return F.when(F.size(known) > 0, F.concat(F.lit("Today clusters around: "), F.array_join(known, ", "), F.lit("."))).otherwise("")


def plain_item(draft: Column, evidence: Column, strength: Column) -> Column:
    """An item made of a draft (title, summary, persona, why_matters) and its evidence alone, without new claims."""
    title, summary, persona = (F.substring(x, 1, n) for x, n in ((nz(draft["title"], "Item"), 80), (_z(draft["summary"]), 200), (_z(draft["persona"]), 80)))
    why = F.substring(nz(draft["why_matters"], summary), 1, 150)
    # Texts that stand in for missing ones.
    hook = first_words(title, 14)
    hook = first_words(F.when(n_words(hook) < 8, F.concat(hook, F.lit(" — worth watching."))).otherwise(hook), 14)
    wedge = F.when((persona != "") & (summary != ""), "Start with builders who face this, build the first feature that unblocks them.").otherwise("Unclear from evidence.")
    return F.struct(
        hook.alias("hook"), nz(summary, "See evidence.").alias("explanation"), F.array(nz(why, "See links below.")).alias("why_bullets"), nz(persona, "Builders and operators").alias("who"), wedge.alias("wedge"),
        first_n(evidence["snippets"], 3).alias("evidence_snippets"), first_n(evidence["links"], 3).alias("links"), F.when(strength.isin("Low", "Med", "High"), strength).otherwise("Med").alias("strength_or_impact"),
    )


def prompt_bullets(bullets: Column) -> Column:
    """Evidence as lines of a prompt."""
    line = lambda b: F.concat(F.lit('- "'), F.substring(strip(_z(b["quote"])), 1, 200), F.lit('" — Post: '), _z(b["post_url"]), F.lit(" — Comment: "), nz(b["comment_url"], "(none)"))
    return F.when(F.coalesce(F.size(bullets), F.lit(0)) > 0, F.array_join(F.transform(first_n(bullets, 15), line), "\n")).otherwise("(no structured evidence)")


def idea_markdown(c: Column) -> Column:
    """An idea card as markdown."""

    def signal(name: str, s: Column) -> Column:
        links = F.transform(F.filter(first_n(s["links"], 3), lambda u: u != ""), lambda u: F.concat(F.lit("- "), u))
        said = F.concat(_line(f"**{name}:** ", s["claim"]), _if(F.size(s["evidence_snippets"]) > 0, _line("Evidence: ", F.array_join(first_n(s["evidence_snippets"], 3), "; "))), links, _line(""))
        return _if(_z(s["claim"]) != "", said)

    now = F.filter(first_n(c["why_now"], 3), lambda w: w != "")
    return _lines(
        _line("### **", nz(c["idea_title"], "Theme"), "**"), _line(""), _line(_z(c["hook"])), _line(""), _line(_z(c["what_happened"])), _line(""), signal("Pain signal", c["pain_signal"]), signal("Catalyst signal", c["catalyst_signal"]),
        _if(F.size(c["why_now"]) > 0, F.concat(F.transform(now, lambda w: F.concat(F.lit("- "), w)), _line(""))), _if(_z(c["wedge"]) != "", _line("**Wedge:** ", c["wedge"])), _if(_z(c["inference"]) != "", _line("**Inference:** ", c["inference"])),
        _line(""), _line("**Confidence:** ", F.format_number(c["confidence"], 2)), _line(""),
    )


def one_bet(items: Column, threshold: float = 0.4) -> Column:
    """The wedge of the first item with the greatest score, of an array of (ordinal, score, wedge)."""
    best = F.get(F.array_sort(items, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["ordinal"] < b["ordinal"], -1).otherwise(1)), F.lit(0))
    head = F.when(best["score"] >= threshold, "One line I'd bet on: ").otherwise("Worth exploring: ")
    return F.when(F.size(items) > 0, F.concat(head, best["wedge"])).otherwise("Worth exploring: re-run with more data.")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline_html(c: Column) -> Column:
    """Escaped, with bold, italics, code and links of inline markdown as HTML, and without leading hashes."""
    c = F.regexp_replace(escape_html(F.regexp_replace(_z(c), r"^#+\s*", "")), r"`([^`]+)`", "<code>$1</code>")
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"\*([^*]+)\*", "<em>$1</em>")
    return F.regexp_replace(c, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>')


def parse_themes(c: Column) -> Column:
    """Up to four themes of a line such as "Today's themes: a, b; c."."""
    rest = F.regexp_replace(F.regexp_replace(_z(c), r"^[^:]*:\s*", ""), r"\.\s*$", "")
    return first_n(F.filter(F.transform(F.split(rest, "[,;]"), strip), lambda s: s != ""), 4)


_DRAFT = "*(Draft — needs more receipts)*"


def parse_card(md: Column) -> Column:
    """A card's markdown read back; lists are read to their end, and whether a draft marker stands before it."""
    field = lambda name: strip(F.regexp_extract(md, rf"(?m)^\*\*{name}:\*\*[ \t]*(.*)$", 1))
    block = lambda name: F.filter(F.regexp_extract_all(F.regexp_extract(md, rf"(?m)^\*\*{name}:\*\*[ \t]*\n((?:- .*\n?)+)", 1), F.lit(r"(?m)^- (.*)$"), 1), lambda s: s != "")
    wedge = lambda name: strip(F.regexp_extract(md, rf"(?m)^- {name}:[ \t]*(.*)$", 1))
    hook = strip(F.regexp_extract(md, r"(?s)### \*\*[^\n]*\*\*\n(.*?)(?=\n\*\*|\Z)", 1))
    return F.struct(
        F.regexp_extract(md, r"(?m)^### \*\*(.*)\*\*$", 1).alias("title"), F.regexp_replace(hook, r"\s*\n\s*", " ").alias("hook"), field("Problem").alias("problem"), field("Who is affected").alias("who_is_affected"), field("Who pays").alias("who_pays"),
        field("Why existing tools fail").alias("why_existing_tools_fail"), block("Evidence").alias("evidence"), block("Stakes").alias("stakes"), block("Why now").alias("why_now"),
        F.struct(*[wedge(n).alias(k) for n, k in (("ICP", "icp"), ("MVP", "mvp"), ("Why they pay", "why_they_pay"), ("First channel", "first_channel"), ("Anti-feature", "anti_feature"))]).alias("wedge"),
        field("Confidence").alias("confidence"), field("Kill criteria").alias("kill_criteria"), F.startswith(strip(md), F.lit(_DRAFT)).alias("is_draft"),
    )


def report_markdown(name: Column, day: Column, cards: Column, bet: Column, rejects: Column, drops: Column) -> Column:
    """A day's report.

    ``cards`` are structs (card, warnings); ``rejects`` structs (kind, index, reason) of the gate, and ``drops``
    structs (title, errors) of the validation.  Fewer than two cards are shown as drafts.
    """
    draft = F.size(cards) < 2
    line = themes(F.transform(cards, lambda c: _z(c["card"]["title"])))
    shown = F.transform(cards, lambda c: F.when(draft, card_markdown(c["card"], c["warnings"], F.lit(True))).otherwise(card_markdown(c["card"], c["warnings"], F.lit(False))))
    gate = F.transform(rejects, lambda r: F.concat(F.lit("- **"), _z(r["kind"]), F.lit("** index "), _z(r["index"]), F.lit(": "), _z(r["reason"])))
    out = F.transform(drops, lambda r: F.concat(F.lit('- **Card dropped** "'), F.substring(_z(r["title"]), 1, 60), F.lit('": '), F.array_join(r["errors"], ", ")))
    return _lines(
        _line("# ", name, " — ", day), _line(""), _line(INTRO), _line(""), _line(""), _if(line != "", F.concat(_line(line), _line(""))),
        _line(F.when(draft, "## Draft / Needs more receipts").otherwise("## Startup-Grade Idea Cards")), _line(""), shown, _line("---"), _line(""), _line("One bet: ", bet), _line(""),
        _if((F.size(rejects) > 0) | (F.size(drops) > 0), F.concat(_line("---"), _line(""), _line("## Rejects (buildability gate)"), _line(""), gate, out, _line(""))),
    )


def parse_report(md: Column) -> Column:
    """struct(date, title, intro, themes_line, section_title, cards, one_bet, rejects) of a report; null without a dated heading.

    A draft marker belongs to the card that follows it.
    """
    line = lambda pattern, g=1: strip(F.regexp_extract(md, pattern, g))
    day = line(r"(?m)^# .* — (.*)$")
    head = F.get(F.split(md, r"(?m)^---$"), F.lit(0))
    blocks = F.filter(F.split(head, r"(?m)(?=^\*\(Draft [^\n]*\)\*\n\n### \*\*)|(?<!\)\*\n\n)(?=^### \*\*)"), lambda b: F.contains(b, F.lit("### **")))
    rejects = F.regexp_extract_all(F.regexp_extract(md, r"(?s)\n## Rejects \(buildability gate\)\n(.*)\Z", 1), F.lit(r"(?m)^- (.*)$"), 1)
    out = F.struct(
        day.alias("date"), line(r"(?m)^# (.*)$").alias("title"), F.when(F.contains(md, F.lit(INTRO)), INTRO).otherwise("").alias("intro"), line(r"(?m)^(Today's themes:.*)$").alias("themes_line"), line(r"(?m)^(## (?:Draft / Needs|Startup-Grade).*)$").alias("section_title"),
        F.transform(blocks, parse_card).alias("cards"), line(r"(?m)^One bet:(.*)$").alias("one_bet"), F.filter(rejects, lambda r: r != "").alias("rejects"),
    )
    return F.when(day != "", out)


def issue_html(issue: Column, view_url: str = "#", leave_url: str = "#") -> Column:
    """A parsed report as an HTML mail: tables with inline styles, every text escaped once, no markdown left."""
    cell = lambda style, *parts: F.concat(F.lit(f'<tr><td style="{style}">'), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("</td></tr>"))
    row = lambda name, value: let(value, lambda v: F.when(v != "", cell("padding:4px 0", f"<b>{name}</b><br>", v)).otherwise(""))
    text = lambda c: inline_html(_z(c))
    dots = lambda a: F.array_join(F.transform(a, text), " · ")
    bullets = lambda a: F.when(F.size(a) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(a, lambda e: F.concat(F.lit("<li>"), text(e), F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise("")
    mark = "&amp;" if "?" in view_url else "?"

    def card(c: Column, i: Column) -> Column:
        badges = F.concat(F.when(c["is_draft"], "[Draft] ").otherwise(""), text(c["confidence"]))
        return F.concat(
            F.lit('<table width="100%" style="border:1px solid #ccc;margin-bottom:24px"><tbody>'), let(badges, lambda b: F.when(b != "", cell("font-size:11px", b)).otherwise("")), cell("font-size:18px;font-weight:700", text(c["title"])), row("Hook", text(c["hook"])),
            row("Problem", text(c["problem"])), row("Who pays", text(c["who_pays"])), row("Why existing tools fail", text(c["why_existing_tools_fail"])), row("What a wedge could look like", text(c["wedge"]["mvp"])), row("Evidence", bullets(c["evidence"])),
            row("Stakes", dots(c["stakes"])), row("Why now", dots(c["why_now"])), row("Kill criteria", text(c["kill_criteria"])), cell("padding:8px 0", f'<a href="{view_url}{mark}card=', i.cast("string"), '">Read cluster</a>'), F.lit("</tbody></table>"),
        )

    title = F.regexp_replace(F.regexp_replace(_z(issue["title"]), r"^#+\s*", ""), r"\s*—\s*.+$", "")
    pills = F.array_join(F.transform(parse_themes(issue["themes_line"]), lambda t: F.concat(F.lit('<span style="padding:6px 14px">'), escape_html(t), F.lit("</span>"))), "")
    body = F.concat(
        cell("font-size:22px", escape_html(title)), cell("font-size:15px", text(issue["intro"])), cell("padding:0", pills), cell("font-size:17px", text(issue["section_title"])), cell("padding:0", F.array_join(F.transform(issue["cards"], card), "")),
        F.when(_z(issue["one_bet"]) != "", cell("padding:8px 0", "<b>One bet:</b> ", text(issue["one_bet"]))).otherwise(""), F.when(F.size(issue["rejects"]) > 0, cell("padding:8px 0", "<b>Rejects (buildability gate)</b>", bullets(issue["rejects"]))).otherwise(""),
        cell("font-size:13px", f'<a href="{leave_url}">Unsubscribe</a> · <a href="{view_url}">View in browser</a>'),
    )
    return F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), escape_html(title), F.lit('</title></head><body><table width="600" align="center"><tbody>'), body, F.lit("</tbody></table></body></html>"))


