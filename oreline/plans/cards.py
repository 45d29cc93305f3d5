"""Queries of evidence, items, cards, reports and answers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import evidence, lexicons, normalise, render, scoring, validate
from ..operators import relational, report
from ..sources import provider
from . import views
from .registry import first_words, has_any, lines, literal, n_contained, n_words, query, some, strip, words
from .views import CARDS, HN, ITEMS, LABELS, POSTS, cards, posts

_P = f"WITH {ITEMS},\n{POSTS}\n"
_C = f"WITH {CARDS}\n"


# ---- scores and evidence of posts

_BOTH = "CASE WHEN title <> '' THEN title || chr(10) || text ELSE text END"
_N_PATTERNS = "(" + " + ".join(f"regexp_matches(lower(b), {literal(p)})::INT" for p in lexicons.PAIN_PATTERNS) + ")"


@query(_P + rf"SELECT id, round(CASE WHEN regexp_matches(b, '[^\s\p{{Z}}]') THEN least(1, 0.15::DOUBLE * {_N_PATTERNS} + CASE WHEN contains(b, '?') THEN 0.2::DOUBLE ELSE 0 END) ELSE 0 END, 6) AS score FROM (SELECT id, {_BOTH} AS b FROM v_posts)")
def pain_heuristic(spark, sf):
    return posts(spark, sf).select("id", F.round(scoring.pain_heuristic(F.col("text"), F.col("title")), 6).alias("score"))


_LABELLED = f"WITH {ITEMS},\n{POSTS},\n{LABELS}\n"


@query(_LABELLED + rf"SELECT id, (0.5::DOUBLE * CASE WHEN regexp_matches(b, '[^\s\p{{Z}}]') THEN least(1, 0.15::DOUBLE * {_N_PATTERNS} + CASE WHEN contains(b, '?') THEN 0.2::DOUBLE ELSE 0 END) ELSE 0 END + CASE label WHEN 'PAIN' THEN 0.5::DOUBLE WHEN 'DISCUSSION' THEN 0.3::DOUBLE ELSE 0 END * confidence::DOUBLE)::DECIMAL(12,6)::DECIMAL(5,2) AS pain FROM (SELECT id, {_BOTH} AS b FROM v_posts) JOIN v_labels USING (id)")
def combined_pain_score(spark, sf):
    x = posts(spark, sf).join(views.labels(spark, sf).select("id", "label", "confidence"), "id")
    return x.select("id", scoring.combined_pain(scoring.pain_heuristic(F.col("text"), F.col("title")), F.col("label"), F.col("confidence")).alias("pain"))


@query(_P + f"SELECT id, {has_any('array_to_string(evidence_snippets, chr(32))', lexicons.SPAN_WORDS)} AS pain FROM v_posts")
def span_pain(spark, sf):
    return posts(spark, sf).select("id", scoring.span_shows_pain(F.col("evidence_snippets")).alias("pain"))


_SHOWS = lambda s: has_any(s, lexicons.PAIN_WORDS)


@query(
    _P + rf""", d AS (SELECT id, {strip('title')} AS title, {strip('text')} AS body FROM v_posts),
 s AS (SELECT id, 0 AS o, {first_words('title')} AS s FROM d WHERE {_SHOWS('title')}
  UNION ALL SELECT id, o, {first_words('p')} FROM (SELECT id, generate_subscripts(ps, 1) AS o, unnest(list_transform(ps, lambda x: {strip('x')})) AS p FROM (SELECT id, regexp_split_to_array(replace(title || chr(10) || chr(10) || body, chr(10), '. '), '[.!?]\s+') AS ps FROM d)) WHERE length(p) > 10 AND {_SHOWS('p')} AND {n_words('p')} >= 3),
 f AS (SELECT id, s, o, row_number() OVER (PARTITION BY id, lower(s) ORDER BY o) AS k FROM s), g AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM f WHERE k = 1), h AS (SELECT id, string_agg(s, ' || ' ORDER BY n) AS x FROM g WHERE n <= 4 GROUP BY 1)
 SELECT d.id, coalesce(h.x, {first_words("CASE WHEN title <> '' THEN title ELSE body END")}) AS snippets FROM d LEFT JOIN h USING (id)"""
)
def evidence_snippets(spark, sf):
    return posts(spark, sf).select("id", F.array_join(evidence.snippets(F.col("title"), F.col("text")), " || ").alias("snippets"))


_TAGS = f"list_filter(list_transform(topic_tags, lambda t: lower({strip('t')})), lambda t: t <> '')"
_HITS = f"len(list_filter(evidence_snippets, lambda s: len(list_filter({_TAGS}, lambda t: contains(lower(s), t))) > 0))"
_DIRECT = n_contained("array_to_string(evidence_snippets, ' ')", lexicons.DIRECT_INDICATORS)


@query(
    _P + f"""SELECT id, direct >= 1 OR hits >= 2 AS passed, CASE WHEN direct >= 1 THEN 'direct_indicator_hits=' || direct WHEN hits >= 2 THEN 'snippet_keyword_hits=' || hits || ' across topic_tags'
 ELSE 'insufficient support: snippet_keyword_hits=' || hits || ' (need >=2), direct_indicator_hits=' || direct || ' (need >=1)' END AS reason FROM (SELECT id, {_HITS} AS hits, {_DIRECT} AS direct FROM v_posts)"""
)
def topic_coherence(spark, sf):
    return posts(spark, sf).withColumn("c", evidence.coherence(F.col("topic_tags"), F.col("evidence_snippets"))).select("id", "c.passed", "c.reason")


_URL = f"CASE WHEN coalesce(url, '') <> '' THEN url WHEN source_id <> '' THEN '{HN}' || source_id ELSE '' END"
_BULLETS = f"""t AS (SELECT id, source = 'hn' AND source_id <> '' AS threaded, {_URL} AS own, evidence_snippets AS snips, comments, source_id FROM v_posts),
 chosen AS (SELECT id, threaded, own, source_id, generate_subscripts(l, 1) AS n, unnest(l) AS q FROM (SELECT *, list_filter(list_transform(snips[1:CASE WHEN threaded THEN 5 ELSE 3 END], lambda s: {strip('s')}), lambda s: s <> '') AS l FROM t)),
 claims AS (SELECT id, generate_subscripts(comments, 1) AS pos_, unnest(comments) AS c, unnest(list_transform(comments, lambda c: list_filter(list_transform(snips, lambda s: {strip('s')}), lambda x: x <> '' AND {n_words('x')} <= 12 AND (contains({strip('c.text')}, x) OR (length(x) >= 8 AND contains(lower(c.text), lower(x)))))[1])) AS claim FROM t),
 b AS (SELECT ch.id, n, substring(q, 1, 200) AS quote, source_id AS post_id, own, threaded, (SELECT arg_max(c, pos_) FROM claims WHERE claims.id = ch.id AND threaded AND claim = q) AS c FROM chosen ch)"""


@query(_P + f", {_BULLETS} SELECT id, n::INT - 1 AS ordinal, quote, post_id, coalesce(nullif(c.post_url, ''), own) AS post_url, c.comment_id AS comment_id, c.comment_url AS comment_url FROM b")
def evidence_bullets(spark, sf):
    x = posts(spark, sf).withColumn("item", F.struct("source", "source_id", "url", "evidence_snippets", "comments"))
    return x.select("id", F.posexplode(evidence.bullets(F.col("item"))).alias("ordinal", "b")).select("id", "ordinal", "b.quote", "b.post_id", "b.post_url", "b.comment_id", "b.comment_url")


def _bundle_sql(source: str, key: str) -> str:
    """CTEs named found and bundle over rows (key, o, title, text, url, snips) in their order o; snippets are stored ones, topped up from titles and texts."""
    return f"""few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o) AS r FROM {source}) WHERE r <= 15),
 stored AS (SELECT {key}, s, min(r * 100 + k) AS pos_ FROM (SELECT {key}, r, generate_subscripts(snips, 1) AS k, unnest(list_transform(snips, lambda x: {strip('x')})) AS s FROM few) WHERE s <> '' AND {n_words('s')} <= 12 GROUP BY ALL),
 three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos_) AS n FROM stored) WHERE n <= 3),
 stop AS (SELECT {key}, count(*) AS n, max(pos_ // 100) AS r FROM three GROUP BY {key}),
 read AS (SELECT few.*, coalesce(stop.n, 0) AS n_stored FROM few LEFT JOIN stop USING ({key}) WHERE coalesce(stop.n, 0) < 3 OR few.r <= stop.r),
 links AS (SELECT {key}, list(url ORDER BY r)[1:3] AS links FROM (SELECT {key}, url, min(r) AS r FROM read WHERE coalesce(url, '') <> '' GROUP BY ALL) GROUP BY {key}),
 more AS (SELECT {key}, s, pos_ FROM three UNION ALL SELECT {key}, {first_words('title')}, 10000 + r * 2 FROM read WHERE n_stored < 3 UNION ALL SELECT {key}, {first_words('substring(text, 1, 200)')}, 10001 + r * 2 FROM read WHERE n_stored < 3),
 snips AS (SELECT {key}, list(s ORDER BY pos_)[1:3] AS snippets FROM (SELECT {key}, s, min(pos_) AS pos_ FROM more WHERE s <> '' GROUP BY ALL) GROUP BY {key}),
 bundle AS (SELECT k.*, coalesce(snippets, []) AS snippets, coalesce(links, []) AS links FROM (SELECT DISTINCT {key} FROM few) k LEFT JOIN snips USING ({key}) LEFT JOIN links USING ({key}))"""


def _first_items(spark, sf, key: Column, n: int = 15):
    """Per key the first n posts as a list of items, and the number of all."""
    x = posts(spark, sf).withColumn("key", key)
    all_ = x.groupBy("key").agg(F.count("*").cast("int").alias("size"))
    few = relational.top_per_key(x, ["key"], [F.col("id")], n).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "title", F.substring("text", 1, 200).alias("text"), "url", "evidence_snippets"))).alias("items"))
    return few.withColumn("items", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("title", "text", "url", "evidence_snippets")]))).join(all_, "key")


@query(_P + f", src AS (SELECT cluster, id AS o, title, text, url, evidence_snippets AS snips FROM v_posts), {_bundle_sql('src', 'cluster')} SELECT cluster, array_to_string(snippets, '|') AS snippets, array_to_string(links, '|') AS links FROM bundle")
def evidence_bundle(spark, sf):
    x = _first_items(spark, sf, F.col("cluster")).withColumn("b", evidence.bundle(F.col("items")))
    return x.select(F.col("key").alias("cluster"), F.array_join("b.snippets", "|").alias("snippets"), F.array_join("b.links", "|").alias("links"))


@query(_P + f"SELECT id, array_to_string(list_filter([{first_words('title')}, {first_words('substring(text, 1, 300)')}], lambda s: s <> ''), '|') AS snippets, array_to_string([x for x in [url, 'http://b/1', 'http://b/2', 'http://b/3'] if x IS NOT NULL][1:3], '|') AS links FROM v_posts")
def catalyst_evidence(spark, sf):
    urls = F.array_compact(F.array(F.col("url"), F.lit("http://b/1"), F.lit("http://b/2"), F.lit("http://b/3")))
    x = posts(spark, sf).withColumn("b", evidence.catalyst_bundle(F.col("title"), F.substring("text", 1, 300), urls))
    return x.select("id", F.array_join("b.snippets", "|").alias("snippets"), F.array_join("b.links", "|").alias("links"))


# ---- grades, dedupe

_GRADE = "CASE g WHEN 'Low' THEN 0.2::DOUBLE WHEN 'Med' THEN 0.5::DOUBLE WHEN 'High' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END"


@query(_C + f"SELECT id, round(least(1, {_GRADE} + CASE WHEN {n_words('who_pays')} >= 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {n_words('hook')} >= 5 THEN 0.1::DOUBLE ELSE 0 END), 6) AS pain, round(least(1, {_GRADE} + CASE WHEN {n_words('problem')} >= 5 THEN 0.15::DOUBLE ELSE 0 END), 6) AS catalyst FROM (SELECT *, ['Low', 'Med', 'High', '?'][id % 4 + 1] AS g FROM v_cards)")
def buildability(spark, sf):
    g = F.element_at(F.array(*map(F.lit, ("Low", "Med", "High", "?"))), (F.col("id") % 4 + 1).cast("int"))
    return cards(spark, sf).select("id", F.round(scoring.buildability_pain(g, F.col("card.who_pays"), F.col("card.hook")), 6).alias("pain"), F.round(scoring.buildability_catalyst(g, F.col("card.problem")), 6).alias("catalyst"))


def _greedy(n: int, ok) -> str:
    """CTEs g1 .. gn that keep element i of ``l`` if ok(i)."""
    steps = ["g0 AS (SELECT id, l, []::VARCHAR[] AS seen, []::INT[] AS kept FROM src)"]
    for i in range(1, n + 1):
        good = f"len(l) >= {i} AND {ok(i)}"
        steps.append(f"g{i} AS (SELECT id, l, CASE WHEN {good} THEN seen || l[{i}].tags ELSE seen END AS seen, CASE WHEN {good} THEN kept || [{i - 1}] ELSE kept END AS kept FROM g{i - 1})")
    return ",\n ".join(steps)


_CATS = "[{'tags': [(id % 5)::VARCHAR, 'a'], 'c': ''}, {'tags': ['b', (id % 3)::VARCHAR], 'c': NULL}, {'tags': ['a', 'd'], 'c': CASE WHEN id % 2 = 0 THEN 'theme' ELSE ' ' END}, {'tags': []::VARCHAR[], 'c': ''}, {'tags': ['d'], 'c': ''}]"


@query(f"WITH src AS (SELECT doc_id AS id, {_CATS} AS l FROM documents),\n {_greedy(5, lambda i: f'''(NOT list_has_any(seen, l[{i}].tags) OR {strip(f'l[{i}].c')} <> '')''')}\n SELECT id, array_to_string(kept, ',') AS kept FROM g5")
def greedy_dedupe(spark, sf):
    """Catalysts of a list, each kept if its tags are new or it says what it connects to."""
    k = F.col("doc_id")
    cat = lambda name, tags, c: F.struct(F.lit(name).alias("title"), (F.array(*[x if isinstance(x, Column) else F.lit(x) for x in tags]) if tags else F.array().cast("array<string>")).alias("topic_tags"), (c if isinstance(c, Column) else F.lit(c).cast("string")).alias("connects_to"))
    num = lambda n: F.concat(F.lit(" "), (k % n).cast("string"))
    all_ = F.array(cat("0", [num(5), "A "], ""), cat("1", ["b", num(3)], None), cat("2", ["a", "D"], F.when(k % 2 == 0, "theme").otherwise(" ")), cat("3", [], ""), cat("4", ["d", ""], ""))
    return views.table(spark, sf, "documents").select(k.alias("id"), F.array_join(F.transform(report.distinct_catalysts(all_), lambda c: c["title"]), ",").alias("kept"))


# ---- cards

_EV = "evidence"
_S = strip
_GENERIC = lambda x: f"lower({strip(x)}) IN ('developers', 'developer')"
_VERBS = literal(lexicons.FAILURE_VERBS)
_FAILURE = f"(length({_S('title')}) >= 5 AND ({has_any(_S('title'), lexicons.FAILURE_SIGNS)} OR len(list_filter({words('lower(title)')}, lambda v: list_has_any({_VERBS}, [rtrim(v, 's'), rtrim(v, 'ed'), rtrim(v, 'ing')]))) > 0 OR {n_words('title')} >= 5))"
_STAKE = f"len(list_filter(stakes, lambda s: {has_any('s', lexicons.STAKES)})) > 0"
_BUYER = lambda x: f"(length({_S(x)}) >= 5 AND NOT {_GENERIC(x)} AND len(list_filter({words(x)}, lambda v: length(v) > 1)) >= 2)"
_BANNED = lambda *xs: has_any(" || chr(10) || ".join(f"coalesce({x}, '')" for x in xs), lexicons.CARD_BANNED)
_EACH = lambda *cases: f"flatten(list_transform(evidence, lambda e: {some(*cases)}))"
_OUT = lambda u: f"{_S(u)} <> '' AND NOT list_contains(allowed, {_S(u)})"

_HARD = " || ".join(
    [
        some((f"{n_words('title')} = 0", "title required"), (f"{n_words('title')} BETWEEN 4 AND 12 AND NOT {_FAILURE}", "title must imply failure mode"), (f"{n_words('hook')} = 0", "hook required"), (f"{_S('problem')} = ''", "problem required"), ("len(evidence) = 0", "evidence missing entirely")),
        _EACH((_OUT("e.post_url"), "evidence contains invented post link"), (_OUT("e.comment_url"), "evidence contains invented comment link")),
        some(
            (f"len(evidence) > 0 AND len(list_filter(evidence, lambda e: {_S('e.post_url')} <> '' AND list_contains(allowed, {_S('e.post_url')}))) = 0", "evidence has no post_url links"), (_GENERIC("who_pays"), "buyer/owner undefined (generic 'developers' with no role/team)"),
            ("NOT has_wedge", "wedge must be object"), (f"has_wedge AND {_S('mvp')} = ''", "wedge.mvp required"), (f"{_S('kill_criteria')} = ''", "kill_criteria required"),
            (_BANNED("title", "hook", "problem", "who_pays", "kill_criteria"), "banned phrase in content"), (f"has_wedge AND {_BANNED('icp', 'mvp', 'why_they_pay', 'first_channel', 'anti_feature')}", "banned phrase in wedge"),
            (f"len(list_filter(why_now, lambda s: {has_any('s', lexicons.CARD_BANNED)})) > 0", "banned phrase in why_now"),
        ),
    ]
)
_SOFT = " || ".join(
    [
        some((f"{n_words('title')} > 0 AND NOT {n_words('title')} BETWEEN 4 AND 12", "title must be 4–12 words"), (f"{n_words('hook')} > 0 AND NOT {n_words('hook')} BETWEEN 8 AND 14", "hook must be 8–14 words"), (f"{_S('who_is_affected')} = ''", "who_is_affected missing"), (_GENERIC("who_is_affected"), "who_is_affected must name concrete roles or teams (not just 'developers')")),
        _EACH((f"{_S('e.quote')} = ''", "evidence bullet missing quote"), (f"{n_words('e.quote')} > 12", "evidence quote must be ≤12 words")),
        some(
            (f"{_S('who_pays')} = ''", "who_pays missing"), (f"{_S('who_pays')} <> '' AND NOT {_GENERIC('who_pays')} AND NOT {_BUYER('who_pays')}", "who_pays should include role + org type"),
            (f"NOT ({_STAKE})", "stakes must include at least one (time, reliability, security, money); proxy/estimate allowed if labeled"),
            (f"has_wedge AND {_S('mvp')} <> '' AND NOT (length({_S('mvp')}) >= 10 AND {has_any('mvp', lexicons.TANGIBLE)})", "wedge.mvp should include tangible artifact (scanner, diff, CLI, etc.)"),
            *[(f"has_wedge AND {_S(k)} = ''", f"wedge.{k} missing") for k in ("icp", "why_they_pay", "first_channel", "anti_feature")], (f"lower({_S('confidence')}) NOT IN ('', 'low', 'med', 'high')", "confidence must be low|med|high"),
        ),
    ]
)
_WARN = _EACH((f"{_S('e.comment_url')} = ''", "comment link missing"))
_HAS = lambda x, *w: has_any(x, list(w))
_INFERRED = f"""CASE WHEN {_HAS('title', 'security', 'vulnerability')} OR {_HAS('problem', 'security', 'vuln')} THEN 'SecEng / AppSec teams at product companies' WHEN {_HAS('title', 'api', 'call')} OR {_HAS('problem', 'api')} THEN 'Platform / backend teams at scale'
 WHEN {_HAS('title', 'offline', 'private', 'scan')} THEN 'Security and compliance teams in regulated orgs' WHEN {_HAS('title', 'ai', 'code', 'generated')} THEN 'Engineering leads and platform teams shipping AI-generated code' WHEN {_S('who_pays')} <> '' THEN {_S('who_pays')} ELSE 'Platform / SRE teams at product companies' END"""
_CHANGED = f"""(CASE WHEN {_BUYER('who_pays')} THEN who_pays ELSE {_INFERRED} END) AS who_pays, list_transform(evidence, lambda e: {{'quote': substring({_S('e.quote')}, 1, 200), 'post_url': nullif({_S('e.post_url')}, ''), 'comment_url': nullif({_S('e.comment_url')}, '')}}) AS evidence,
 CASE WHEN {_STAKE} THEN stakes ELSE {literal(lexicons.PROXY_STAKES)} || stakes[1:3] END AS stakes, CASE WHEN lower({_S('confidence')}) = 'low' THEN 'low' ELSE 'med' END AS confidence"""
_CHECKED = f"""{CARDS},
v1 AS (SELECT *, {_HARD} AS hard, {_SOFT} AS soft, {_WARN} AS warns FROM v_cards),
fixed AS (SELECT * REPLACE ({_CHANGED}) FROM v_cards),
v2 AS (SELECT *, {_HARD} AS hard, {_SOFT} AS soft, {_WARN} AS warns FROM fixed)"""


@query(f"WITH {_CHECKED} SELECT id, array_to_string(hard, '|') AS hard, array_to_string(soft, '|') AS soft, array_to_string(warns, '|') AS warnings FROM v1")
def card_validate(spark, sf):
    x = cards(spark, sf).withColumn("e", validate.card_errors(F.col("card"), F.col("allowed")))
    return x.select("id", *[F.array_join(f"e.{k}", "|").alias(k) for k in ("hard", "soft", "warnings")])


@query(f"WITH {_CHECKED} SELECT id, who_pays, array_to_string(stakes, '|') AS stakes, confidence, array_to_string(list_transform(evidence, lambda e: e.quote || '>' || coalesce(e.post_url, '-') || '>' || coalesce(e.comment_url, '-')), '|') AS evidence FROM fixed")
def card_repair(spark, sf):
    x = cards(spark, sf).select("id", validate.repaired(F.col("card")).alias("c"))
    shown = F.transform("c.evidence", lambda e: F.concat(e["quote"], F.lit(">"), F.coalesce(e["post_url"], F.lit("-")), F.lit(">"), F.coalesce(e["comment_url"], F.lit("-"))))
    return x.select("id", "c.who_pays", F.array_join("c.stakes", "|").alias("stakes"), "c.confidence", F.array_join(shown, "|").alias("evidence"))


_ACCEPTED = f"""{_CHECKED}, judged AS (SELECT a.id, len(a.hard) > 0 AS bad1, len(a.soft) + len(a.warns) > 0 AS loose, len(b.hard) > 0 AS bad2, a.hard AS h1, a.soft AS s1, a.warns AS n1, b.hard AS h2, b.soft AS s2, b.warns AS n2 FROM v1 a JOIN v2 b USING (id)),
decided AS (SELECT id, loose AND NOT bad1 AS mended, NOT (bad1 OR (loose AND bad2)) AS accepted, CASE WHEN bad1 OR (loose AND bad2) THEN []::VARCHAR[] WHEN loose THEN n1 || n2 || s2 ELSE [] END AS warnings, CASE WHEN bad1 THEN h1 || s1 WHEN loose AND bad2 THEN h2 || s2 ELSE [] END AS errors FROM judged),
final AS (SELECT c.*, d.accepted, d.warnings, d.errors FROM v_cards c JOIN decided d USING (id) WHERE NOT mended UNION ALL SELECT c.*, d.accepted, d.warnings, d.errors FROM fixed c JOIN decided d USING (id) WHERE mended)"""


@query(f"WITH {_ACCEPTED} SELECT id, accepted, array_to_string(warnings, '|') AS warnings, array_to_string(errors, '|') AS errors, who_pays, confidence FROM final")
def accept_cards(spark, sf):
    x = report.accept_cards(cards(spark, sf))
    return x.select("id", "accepted", F.array_join("warnings", "|").alias("warnings"), F.array_join("errors", "|").alias("errors"), "card.who_pays", "card.confidence")


_LINKED = f"len(list_filter(evidence, lambda e: {_S('e.comment_url')} <> ''))"
_THREADS = "len(list_filter(evidence, lambda e: contains(coalesce(e.comment_url, ''), 'news.ycombinator.com/item?id=')))"


@query(_C + f"""SELECT id, round(CASE WHEN len(evidence) > 0 THEN {_LINKED} / len(evidence) ELSE 0 END, 6)::DOUBLE AS share, {_THREADS}::INT AS threads,
 CASE WHEN {_THREADS} < 2 THEN 'low' WHEN len(evidence) = 0 OR {_LINKED} / len(evidence) < 0.7 THEN CASE lower(confidence) WHEN 'high' THEN 'med' WHEN 'med' THEN 'low' ELSE lower(confidence) END ELSE lower(confidence) END AS confidence FROM v_cards""")
def permalink_confidence(spark, sf):
    e = F.col("card.evidence")
    return cards(spark, sf).select("id", F.round(validate.comment_share(e), 6).alias("share"), validate.thread_links(e).alias("threads"), validate.lowered_confidence(F.lower("card.confidence"), e).alias("confidence"))


_Z = lambda x: f"coalesce({x}, '')"
_IF = lambda c, *parts: f"(CASE WHEN {c} THEN {' || '.join(parts)} ELSE []::VARCHAR[] END)"
_LISTED = lambda name, a: _IF(f"len({a}) > 0", f"['**{name}:**']", f"list_transform(list_filter({a}[1:3], lambda s: s <> ''), lambda s: '- ' || s)", "['']")
_BULLET = f"""'"' || {_S('e.quote')} || '" — Post: ' || coalesce(nullif({_S('e.post_url')}, ''), '(none)') || ' — Comment: ' || coalesce(nullif({_S('e.comment_url')}, ''), '(none)')"""
_CONF = "lower(CASE WHEN coalesce(confidence, '') = '' THEN 'med' ELSE confidence END)"


def _card_md(draft: str, warnings: str) -> str:
    return lines(
        _IF(draft, "['*(Draft — needs more receipts)*', '']"), "['### **' || CASE WHEN coalesce(title, '') = '' THEN 'Idea' ELSE title END || '**', '', hook, '', '**Problem:** ' || problem, '']",
        _IF(f"{_S('who_is_affected')} <> ''", f"['**Who is affected:** ' || {_S('who_is_affected')}, '']"), _IF("len(evidence) > 0", "['**Evidence:**']", f"list_transform(evidence[1:5], lambda e: '- ' || {_BULLET})", "['']"),
        "['**Who pays:** ' || who_pays]", _IF(f"{_S('why_existing_tools_fail')} <> ''", f"['**Why existing tools fail:** ' || {_S('why_existing_tools_fail')}]"), _LISTED("Stakes", "stakes"), _LISTED("Why now", "why_now"),
        _IF("has_wedge", "['**Wedge:**', '- ICP: ' || icp, '- MVP: ' || mvp, '- Why they pay: ' || why_they_pay, '- First channel: ' || first_channel, '- Anti-feature: ' || anti_feature, '']"),
        _IF(f"{_CONF} IN ('low', 'med', 'high')", f"['**Confidence:** ' || {_CONF}]"), "['']", _IF("kill_criteria <> ''", "['**Kill criteria:** ' || kill_criteria]"),
        _IF(f"len({warnings}) > 0", f"['', '**Warnings:** ' || array_to_string({warnings}, '; ')]"), "['']",
    )


@query(_C + f"SELECT id, {_card_md('id % 5 = 0', 'ws')} AS markdown FROM (SELECT *, CASE WHEN id % 2 = 0 THEN ['w1', 'w2'] ELSE []::VARCHAR[] END AS ws FROM v_cards)")
def render_card(spark, sf):
    k = F.col("id")
    w = F.when(k % 2 == 0, F.array(F.lit("w1"), F.lit("w2"))).otherwise(F.array().cast("array<string>"))
    return cards(spark, sf).select("id", render.card_markdown(F.col("card"), w, k % 5 == 0).alias("markdown"))


# ---- reports: three cards a day

NAME = "Signals"
_DAY = "'d' || (id // 3)"
_DRAFTS = "count(*) FILTER (accepted) OVER (PARTITION BY id // 3) < 2"
_THEME = strip("title")
_REPORTS = f"""{_ACCEPTED}, shown AS (SELECT *, {_DAY} AS date, {_DRAFTS} AS draft FROM final), md AS (SELECT *, {_card_md('draft', 'warnings')} AS md FROM shown),
days AS (SELECT date, any_value(draft) AS draft, coalesce(list(md ORDER BY id) FILTER (accepted), []) AS mds, list_filter(list_transform(list_filter(coalesce(list(title ORDER BY id) FILTER (accepted), []), lambda t: t <> '')[1:3], lambda t: {strip('t')}), lambda t: t <> '') AS themes,
 list('- **' || CASE id % 2 WHEN 0 THEN 'pain' ELSE 'catalyst' END || '** index ' || (id % 7) || ': not_buildable' ORDER BY id) AS gate, coalesce(list('- **Card dropped** "' || substring(title, 1, 60) || '": ' || array_to_string(errors, ', ') ORDER BY id) FILTER (NOT accepted), []) AS drops FROM md GROUP BY 1)"""
_REPORT_MD = lines(
    f"['# {NAME} — ' || date, '', {literal(render.INTRO)}, '', '']", _IF("len(themes) > 0", "['Today''s themes: ' || array_to_string(themes, ', ') || '.', '']"), "[CASE WHEN draft THEN '## Draft / Needs more receipts' ELSE '## Startup-Grade Idea Cards' END, '']",
    "mds", "['---', '', 'One bet: Bet of ' || date, '', '---', '', '## Rejects (buildability gate)', '']", "gate", "drops", "['']",
)


def _reports(spark, sf):
    day = F.concat(F.lit("d"), F.floor(F.col("id") / 3).cast("string"))
    k = F.col("id")
    gate = {"kind": F.when(k % 2 == 0, "pain").otherwise("catalyst"), "index": (k % 7).cast("string"), "reason": F.lit("not_buildable")}
    # cards and rejects of a day are gathered together, so the texts are read once
    rows = report.accept_cards(cards(spark, sf)).withColumns({"date": day, "ordinal": k, **gate})
    days = report.gathered(rows, report.listed_rejects())
    return report.reports(NAME, days.withColumn("bet", F.concat(F.lit("Bet of "), F.col("date"))))


@query(f"WITH {_REPORTS} SELECT date, {_REPORT_MD} AS markdown FROM days")
def daily_report(spark, sf):
    return _reports(spark, sf)


_TITLE = "CASE WHEN coalesce(title, '') = '' THEN 'Idea' ELSE title END"


@query(f"""WITH {_REPORTS}, c AS (SELECT date, string_agg({_TITLE} || '/' || {_S('who_pays')} || '/' || len(evidence) || '/' || len(list_filter(stakes[1:3], lambda s: s <> '')) || '/' || CASE WHEN has_wedge THEN {_S('mvp')} ELSE '' END || '/' || draft::INT, '|' ORDER BY id) AS cards FROM shown WHERE accepted GROUP BY 1)
 SELECT date, '{NAME} — ' || date AS title, CASE WHEN draft THEN '## Draft / Needs more receipts' ELSE '## Startup-Grade Idea Cards' END AS section_title, coalesce(cards, '') AS cards, 'Bet of ' || date AS one_bet, len(gate) + len(drops) AS n_rejects FROM days LEFT JOIN c USING (date)""")
def parse_report(spark, sf):
    x = _reports(spark, sf).select(render.parse_report(F.col("markdown")).alias("r"))
    shown = F.transform("r.cards", lambda c: F.concat_ws("/", c["title"], c["who_pays"], F.size(c["evidence"]).cast("string"), F.size(c["stakes"]).cast("string"), c["wedge"]["mvp"], c["is_draft"].cast("int").cast("string")))
    return x.select("r.date", "r.title", "r.section_title", F.array_join(shown, "|").alias("cards"), "r.one_bet", F.size("r.rejects").cast("long").alias("n_rejects"))


@query(f"""WITH {_REPORTS} SELECT date, len(mds) AS n_cards, len(gate) + len(drops) AS n_rejects, CASE WHEN draft THEN len(mds) ELSE 0 END AS n_drafts FROM days""")
def issue_mail(spark, sf):
    """What the HTML mail of each report shows: cards, those marked as drafts, rejects."""
    html = F.col("html")
    x = _reports(spark, sf).select(render.parse_report(F.col("markdown")).alias("r")).select("r.date", render.issue_html(F.col("r")).alias("html"))
    rejects = F.regexp_extract(html, r"(?s)Rejects \(buildability gate\).*\Z", 0)
    n = lambda c, mark: F.regexp_count(c, F.lit(mark)).cast("long")
    return x.select("date", n(html, "Read cluster").alias("n_cards"), n(rejects, "<li>").alias("n_rejects"), n(html, r"\[Draft\] ").alias("n_drafts"))


# ---- items made of drafts, and the sample report

_I = f"WITH {ITEMS},\n{POSTS},\n{CARDS}"
_SUM, _PER, _WHY = "substring(summary, 1, 200)", "substring(persona, 1, 80)", "substring(CASE WHEN why <> '' THEN why ELSE substring(summary, 1, 200) END, 1, 150)"
_H14 = first_words("substring(CASE WHEN title <> '' THEN title ELSE 'Item' END, 1, 80)", 14)


def _plain(source: str) -> str:
    """Columns of the item made of a draft (title, summary, persona, why, snippets, links, grade)."""
    return f"""SELECT *, {first_words("CASE WHEN len(string_split(h, ' ')) < 8 THEN h || ' — worth watching.' ELSE h END", 14)} AS hook, CASE WHEN {_SUM} <> '' THEN {_SUM} ELSE 'See evidence.' END AS explanation, CASE WHEN {_WHY} <> '' THEN {_WHY} ELSE 'See links below.' END AS bullet,
 CASE WHEN {_PER} <> '' THEN {_PER} ELSE 'Builders and operators' END AS who, CASE WHEN {_PER} <> '' AND {_SUM} <> '' THEN 'Start with builders who face this, build the first feature that unblocks them.' ELSE 'Unclear from evidence.' END AS wedge FROM (SELECT *, {_H14} AS h FROM {source})"""


def _item_md(label: str) -> str:
    return lines("['### **' || hook || '**', '', explanation, '', '- ' || bullet, '', '**Who:** ' || who, '**Possible wedge:** ' || wedge, " + f"'**{label}:** ' || grade, '', '**Evidence:** ' || array_to_string(snippets[1:3], '; ')]", "list_transform(list_filter(links[1:3], lambda u: u <> ''), lambda u: '- ' || u)", "['']")


_DRAFT_COLS = "id, title, hook AS summary, who_is_affected AS persona, problem AS why, CASE WHEN id % 2 = 0 THEN [kill_criteria, 'one two'] ELSE []::VARCHAR[] END AS snippets, ['http://a', '', 'http://b', 'http://c'] AS links, ['Low', 'Med', 'High', 'Med'][id % 4 + 1] AS grade"


def _drafts(spark, sf):
    k, c = F.col("id"), F.col("card")
    draft = F.struct(c["title"].alias("title"), c["hook"].alias("summary"), c["who_is_affected"].alias("persona"), c["problem"].alias("why_matters"))
    found = F.struct(F.when(k % 2 == 0, F.array(c["kill_criteria"], F.lit("one two"))).otherwise(F.array().cast("array<string>")).alias("snippets"), F.array(*map(F.lit, ("http://a", "", "http://b", "http://c"))).alias("links"))
    grade = F.element_at(F.array(*map(F.lit, ("Low", "Med", "High", "odd"))), (k % 4 + 1).cast("int"))
    return cards(spark, sf).select("id", draft.alias("draft"), found.alias("found"), grade.alias("grade"))


@query(_C + f", src AS (SELECT {_DRAFT_COLS} FROM v_cards), made AS ({_plain('src')}) SELECT id, CASE WHEN id % 3 = 0 THEN {_item_md('Impact')} ELSE {_item_md('Signal strength')} END AS markdown FROM made")
def render_item(spark, sf):
    item = render.plain_item(F.col("draft"), F.col("found"), F.col("grade"))
    return _drafts(spark, sf).select("id", render.item_markdown(item, F.when(F.col("id") % 3 == 0, "catalyst").otherwise("pain")).alias("markdown"))


_TOTAL = " + ".join(n_words(x) for x in ("hook", "problem", "who_pays", "mvp", "confidence")) + " + list_sum(list_transform(why_now, lambda s: " + n_words("s") + ")) + coalesce(list_sum(list_transform(evidence, lambda e: " + n_words("e.quote") + ")), 0)"
_NITEM_BANNED = f"list_transform(list_filter([problem, who_pays, mvp] || why_now, lambda b: {has_any('b', lexicons.BANNED)}), lambda b: 'banned phrase in content')"


@query(
    _C + f"""SELECT id, array_to_string(list_filter([CASE WHEN total > 120 THEN 'word_count_excluding_links=' || total || ' > 120' END, CASE WHEN len(urls) > 3 THEN 'links count ' || len(urls) || ' > 3' END], lambda m: m IS NOT NULL) || {some(('len(evidence) = 0', 'evidence_snippets required'), ('len(urls) = 0', 'at least one link required'))}
 || list_transform(list_filter(evidence, lambda e: NOT {n_words('e.quote')} BETWEEN 1 AND 12), lambda e: 'evidence snippet must be ≤12 words: ''' || substring(e.quote, 1, 50) || '''')
 || {some((f"NOT {n_words('hook')} BETWEEN 8 AND 14", 'hook must be 8–14 words'), ("starts_with(lower(hook), 'this article') OR starts_with(lower(hook), 'this post')", "hook must not start with 'This article' / 'This post'"), ("confidence NOT IN ('Low', 'Med', 'High')", 'strength_or_impact must be Low, Med, or High'))} || {_NITEM_BANNED}, '|') AS errors
 FROM (SELECT *, ({_TOTAL})::BIGINT AS total, ['http://1', 'http://2', 'http://3', 'http://4'][1:id % 5] AS urls FROM v_cards)"""
)
def item_validate(spark, sf):
    c, k = F.col("card"), F.col("id")
    item = F.struct(
        c["hook"].alias("hook"), c["problem"].alias("explanation"), c["why_now"].alias("why_bullets"), c["who_pays"].alias("who"), F.element_at(F.array(F.lit(""), F.lit("an idea only"), *[F.lit("a small cli checker")] * 3), (k % 5 + 1).cast("int")).alias("wedge"),
        F.transform(c["evidence"], lambda e: e["quote"]).alias("evidence_snippets"), F.slice(F.array(*[F.lit(f"http://{j}") for j in range(1, 5)]), F.lit(1), (k % 5).cast("int")).alias("links"), c["confidence"].alias("strength_or_impact"),
    )
    return cards(spark, sf).select("id", F.array_join(validate.item_errors(item), "|").alias("errors"))


# six reports of up to seven clusters each, of which five are shown; catalysts are the first posts of a report
_SAMPLE = f"""src AS (SELECT id % 6 AS g, (id // 6) % 7 AS c, id AS o, title, text, url, evidence_snippets AS snips, (id % 6) * 100 + (id // 6) % 7 AS gc FROM v_posts), {_bundle_sql('src', 'gc')},
 heads AS (SELECT gc, any_value(g) AS g, any_value(c) AS c, count(*) AS size, arg_min(title, o) AS title, arg_min(substring(text, 1, 260), o) AS summary FROM src GROUP BY gc),
 pain_src AS (SELECT g, c AS n, heads.title, summary, CASE WHEN c % 3 = 0 THEN '' ELSE 'Team ' || c END AS persona, CASE WHEN c % 2 = 0 THEN '' ELSE 'It costs ' || size END AS why, snippets, links, CASE WHEN size >= 5 AND (s >= 0.5 OR 0.6 >= 0.7) THEN 'High' WHEN size >= 2 OR s >= 0.4 OR 0.6 >= 0.5 THEN 'Med' ELSE 'Low' END AS grade FROM (SELECT *, CASE WHEN c = 0 THEN 0.5 ELSE c * 0.17 END AS s FROM heads) heads JOIN bundle USING (gc) WHERE c < 5),
 pain AS (SELECT *, 0 AS part, {_item_md('Signal strength')} AS md, least(1, CASE grade WHEN 'Low' THEN 0.2 WHEN 'Med' THEN 0.5 ELSE 0.8 END + CASE WHEN {n_words('who')} >= 2 THEN 0.1 ELSE 0 END + CASE WHEN {n_words('wedge')} >= 5 THEN 0.1 ELSE 0 END) AS score FROM ({_plain('pain_src')}) WHERE len(snippets) > 0 OR len(links) > 0),
 cat_src AS (SELECT g, n, title, summary, '' AS persona, why, list_filter([{first_words('title')}, {first_words('summary')}], lambda x: x <> '') AS snippets, urls AS links, CASE WHEN (n % 4 >= 2 AND len(urls) >= 1) OR {has_any("summary || ' ' || why", lexicons.URGENCY)} THEN 'High' WHEN n % 4 >= 1 OR len(urls) >= 2 THEN 'Med' ELSE 'Low' END AS grade
  FROM (SELECT id % 6 AS g, title, substring(text, 1, 300) AS summary, CASE WHEN r % 3 = 0 THEN '' ELSE {views.said_sql('id', 4)} END AS why, ['http://n/1', 'http://n/2'][1:r % 3] AS urls, r AS n FROM (SELECT *, row_number() OVER (PARTITION BY id % 6 ORDER BY id) - 1 AS r FROM v_posts) WHERE r < 6) WHERE n < 5),
 news AS (SELECT *, 1 AS part, {_item_md('Impact')} AS md, least(1, CASE grade WHEN 'Low' THEN 0.2 WHEN 'Med' THEN 0.5 ELSE 0.8 END + CASE WHEN {n_words('why')} >= 5 THEN 0.15 ELSE 0 END) AS score FROM ({_plain('cat_src')}) WHERE len(snippets) > 0 OR len(links) > 0),
 wild_src AS (SELECT g, 0 AS n, CASE WHEN title <> '' THEN title ELSE 'Item' END AS title, substring(text, 1, 200) AS summary, '' AS persona, '' AS why, list_distinct_kept AS snippets, CASE WHEN coalesce(url, '') <> '' THEN [url] ELSE []::VARCHAR[] END AS links, 'Med' AS grade FROM (SELECT id % 6 AS g, arg_max(title, id) AS title, arg_max(text, id) AS text, arg_max(coalesce(url, ''), id) AS url,
   list_filter([{first_words('arg_max(title, id)')}, {first_words('substring(arg_max(text, id), 1, 200)')}], lambda x: x <> '') AS list_distinct_kept FROM v_posts GROUP BY 1) WHERE g % 2 = 0),
 wild AS (SELECT *, 2 AS part, {_item_md('Signal strength')} AS md, least(1, 0.5 + CASE WHEN {n_words('who')} >= 2 THEN 0.1 ELSE 0 END + CASE WHEN {n_words('wedge')} >= 5 THEN 0.1 ELSE 0 END) AS score FROM ({_plain('wild_src')})),
 every AS (SELECT g, part, n, md, score, wedge FROM pain UNION ALL SELECT g, part, n, md, score, wedge FROM news UNION ALL SELECT g, part, n, md, score, wedge FROM wild),
 bets AS (SELECT g, CASE WHEN score >= 0.4 THEN 'One line I''d bet on: ' ELSE 'Worth exploring: ' END || wedge AS bet FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, part, n) AS r FROM every) WHERE r = 1),
 names AS (SELECT g, 0 AS part, c AS n, {strip('title')} AS t FROM heads WHERE c < 5 UNION ALL SELECT g, 1, n, {strip('title')} FROM cat_src WHERE n < 3), one AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY part, n) AS r FROM (SELECT *, row_number() OVER (PARTITION BY g, lower(t) ORDER BY part, n) AS q FROM names WHERE t <> '') WHERE q = 1),
 themes AS (SELECT g, 'Today clusters around: ' || string_agg(t, ', ' ORDER BY r) || '.' AS line FROM one WHERE r <= 5 GROUP BY 1),
 parts AS (SELECT g, coalesce(list(md ORDER BY n) FILTER (part = 0), []) AS pain, coalesce(list(md ORDER BY n) FILTER (part = 1), []) AS news, coalesce(list(md ORDER BY n) FILTER (part = 2), ['*(None this time.)*', '']) AS wild FROM every GROUP BY 1)"""


@query(f"""WITH {ITEMS},\n{POSTS},\n{_SAMPLE} SELECT g AS report, """ + lines(
    f"['# {NAME} — 2024-01-0' || (g + 1), '', {literal(render.INTRO)}, '', '']", _IF("line IS NOT NULL", "[line, '']"), "['## 1. Top Pain Clusters', '']", "pain", "['## 2. Rising Pain Signals', '', 'No clear risers today.', '', '## 3. Catalyst Signals', '']", "news",
    "['## 4. Wildcard', '']", "wild", "['---', '', bet, '']",
) + " AS markdown FROM parts JOIN bets USING (g) LEFT JOIN themes USING (g)")
def sample_report(spark, sf):
    k = F.col("id")
    x = _first_items(spark, sf, F.struct((k % 6).alias("g"), (F.floor(k / 6) % 7).alias("c"))).select("key.g", "key.c", "items", "size")
    head = posts(spark, sf).withColumns({"g": k % 6, "c": F.floor(k / 6) % 7}).groupBy("g", "c").agg(F.min_by("title", "id").alias("title"), F.min_by(F.substring("text", 1, 260), "id").alias("summary"))
    c = F.col("c")
    cluster = F.struct(
        c.cast("string").alias("id"), "title", "summary", F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("Team "), c.cast("string"))).alias("persona"), F.when(c % 2 == 0, "").otherwise(F.concat(F.lit("It costs "), F.col("size").cast("string"))).alias("why_matters"),
        "size", (c * 0.17).alias("score"), "items",
    )
    bare = lambda a: F.transform(F.array_sort(a), lambda y: y["v"])
    clusters = x.join(head, ["g", "c"]).groupBy("g").agg(bare(F.collect_list(F.struct("c", cluster.alias("v")))).alias("clusters"))
    first = relational.top_per_key(posts(spark, sf).withColumn("g", k % 6), ["g"], [k], 6).withColumn("r", F.col("rank") - 1)
    r = F.col("r")
    cat = F.struct("title", F.substring("text", 1, 300).alias("summary"), F.slice(F.array(*map(F.lit, "xyz")), F.lit(1), (r % 4).cast("int")).alias("interests"), F.when(r % 3 == 0, "").otherwise(views.said(k, 4)).alias("problems_created"), F.slice(F.array(F.lit("http://n/1"), F.lit("http://n/2")), F.lit(1), (r % 3).cast("int")).alias("source_urls"))
    catalysts = first.groupBy("g").agg(bare(F.collect_list(F.struct("r", cat.alias("v")))).alias("catalysts"))
    last = posts(spark, sf).withColumn("g", k % 6).groupBy("g").agg(F.max_by(F.struct("title", "text", "url", F.array().cast("array<string>").alias("evidence_snippets")), "id").alias("w"))
    data = clusters.join(catalysts, "g").join(last, "g").withColumns({"date": F.concat(F.lit("2024-01-0"), (F.col("g") + 1).cast("string")), "wildcard": F.when(F.col("g") % 2 == 0, F.col("w"))})
    return report.sample_report(data, NAME).select(F.col("g").alias("report"), "markdown")


# ---- small renderers

_LETTERS = lambda x: rf"regexp_replace({x}, '[^\p{{L}}]', '', 'g')"


_RUN = lambda a, b: _LETTERS(f"array_to_string(w[{a}:{b}], '')")


@query(_C + f"SELECT id, a || ' <strong>' || b || '</strong> <em>' || c || '</em> <code>' || d || '</code> &lt;' || a || '&gt; &amp; <a href=\"http://y/' || id || '\">' || b || '</a>' AS html FROM (SELECT id, 'x' || {_RUN(1, 15)} AS a, 'y' || {_RUN(16, 30)} AS b, 'z' || {_RUN(31, 45)} AS c, 'q' || {_RUN(46, 60)} AS d FROM v_words)")
def md_to_html(spark, sf):
    bare = lambda n, p: F.concat(F.lit(p), F.regexp_replace(F.array_join(F.slice("w", n * 15 + 1, 15), ""), r"[^\p{L}]", ""))
    x = views.card_words(spark, sf).withColumns({"a": bare(0, "x"), "b": bare(1, "y"), "c": bare(2, "z"), "d": bare(3, "q")})
    md = F.concat(F.lit("## "), F.col("a"), F.lit(" **"), F.col("b"), F.lit("** *"), F.col("c"), F.lit("* `"), F.col("d"), F.lit("` <"), F.col("a"), F.lit("> & ["), F.col("b"), F.lit("](http://y/"), F.col("id").cast("string"), F.lit(")"))
    return x.select("id", render.inline_html(md).alias("html"))


@query(_C + f"SELECT id, CASE WHEN len(ts) > 0 THEN 'Today''s themes: ' || array_to_string(ts, ', ') || '.' ELSE '' END AS line, array_to_string(ts, '|') AS parsed FROM (SELECT id, CASE WHEN id % 4 = 0 THEN [] ELSE ['a' || {_RUN(1, 60)}, 'b' || id] || CASE WHEN id % 2 = 0 THEN ['c'] ELSE [] END END AS ts FROM v_words)")
def themes_round_trip(spark, sf):
    k = F.col("id")
    head = F.concat(F.lit(" a"), F.regexp_replace(F.array_join("w", ""), r"[^\p{L}]", ""), F.lit(" "))
    titles = F.when(k % 4 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.concat(F.array(head, F.lit(""), F.concat(F.lit("b"), k.cast("string"))), F.when(k % 2 == 0, F.array(F.lit("c"), F.lit("over"))).otherwise(F.array().cast("array<string>"))))
    x = views.card_words(spark, sf).select("id", render.themes(titles).alias("line"))
    return x.select("id", "line", F.array_join(render.parse_themes(F.col("line")), "|").alias("parsed"))


@query(f"SELECT c_nationkey AS nation, CASE WHEN s >= 0.4 THEN 'One line I''d bet on: ' ELSE 'Worth exploring: ' END || n AS bet FROM (SELECT c_nationkey, c_name AS n, round(c_acctbal / 20000, 1) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 20000, 1) DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def one_bet(spark, sf):
    c = views.table(spark, sf, "customer").withColumn("s", F.round(F.col("c_acctbal") / 20000, 1))
    best = relational.top_per_key(c, ["c_nationkey"], [F.desc("s"), F.col("c_custkey")], 5)
    # a nation's five best, one of which wins
    x = best.groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_list(F.struct(F.col("c_custkey").cast("int").alias("ordinal"), F.col("s").alias("score"), F.col("c_name").alias("wedge"))).alias("items"))
    return x.select("nation", render.one_bet(F.col("items")).alias("bet"))


# ---- answers of models: JSON made of the words of documents, read back


def _js(c: Column) -> Column:
    """A value as JSON."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _object(**fields: Column) -> Column:
    """A JSON object of values that are JSON already; null ones are left out."""
    # a null value makes its part null; a test for it would work each value out twice, and nested ones twice a level
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _part(a: int, n: int) -> Column:
    return F.array_join(F.slice("w", F.lit(a + 1), F.lit(n)), " ")


_Q = views._seg


@query(_C + f"SELECT id, CASE WHEN bad THEN 'OTHER' WHEN id % 4 = 3 THEN 'OTHER' ELSE ['PAIN', 'NEWS', 'DISCUSSION'][id % 4 + 1] END AS label, CASE WHEN bad THEN 0.5 WHEN id % 5 = 0 THEN 0.5 ELSE [1, 0, 0.25, 0.75][id % 5] END::DOUBLE AS confidence, CASE WHEN bad THEN 0 WHEN id % 2 = 0 THEN 0.5 ELSE 0.125 END::DOUBLE AS audience_fit, CASE WHEN bad THEN 0 ELSE least(5, len(list_filter(w[1:7], lambda x: {strip('x')} <> ''))) END::INT AS n_tags, CASE WHEN bad OR len(w) = 0 THEN '' ELSE {first_words('substring(' + _Q('0', '20') + ', 1, 150)')} END AS anchor, CASE WHEN bad THEN 'parse_fallback' WHEN id % 3 = 0 THEN 'off' END AS exclude_reason FROM (SELECT *, id % 10 = 9 AS bad FROM v_words)")
def json_normalise(spark, sf):
    k = F.col("id")
    label = F.element_at(F.array(*map(F.lit, ("pain", "News", "DISCUSSION", "odd"))), (k % 4 + 1).cast("int"))
    number = F.element_at(F.array(*[F.lit(x).cast("string") for x in (None, "1.7", "-0.5", "0.25", "0.75")]), (k % 5 + 1).cast("int"))
    made = _object(label=_js(label), confidence=number, audience_fit=F.when(k % 2 == 1, F.lit("0.125")), topic_tags=F.to_json(F.slice("w", 1, 7)), claim_anchors=F.to_json(F.array(F.substring(_part(0, 20), 1, 150))), exclude_reason=F.when(k % 3 == 0, _js(F.lit(" off "))).otherwise(F.lit("null")))
    answer = F.when(k % 10 == 9, "garbage, no JSON").when(k % 3 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(made)
    a = views.card_words(spark, sf).withColumn("a", provider.label_answer(answer))
    return a.select("id", "a.label", "a.confidence", "a.audience_fit", F.size("a.topic_tags").alias("n_tags"), F.coalesce(F.get("a.claim_anchors", F.lit(0)), F.lit("")).alias("anchor"), "a.exclude_reason")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN 'OTHER' ELSE ['NEWS', 'PAIN', 'OTHER', 'DISCUSSION'][doc_id % 5 + 1] END AS label, CASE doc_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS confidence FROM documents")
def label_lines(spark, sf):
    k = F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, ("news", " PAIN ", "odd", "Discussion", ""))), (k % 5 + 1).cast("int"))
    number = F.element_at(F.array(*map(F.lit, ("7\n0.4", "none", "1"))), (k % 3 + 1).cast("int"))
    x = views.table(spark, sf, "documents").select(k.alias("id"), provider.label_lines(F.concat(label, F.lit("\n"), number)).alias("a"))
    return x.select("id", "a.label", "a.confidence")


@query(_C + f"""SELECT id, 0 AS ordinal, substring({_Q('0', '40')}, 1, 200) AS title, len(w[1:7][1:5])::INT AS n_tags, substring(CASE WHEN id % 4 = 0 THEN '' ELSE {_Q('3', '20')} END, 1, 500) AS what_changed, substring(CASE WHEN id % 4 = 0 OR {_Q('3', '20')} = '' THEN {_Q('5', '6')} ELSE {_Q('3', '20')} END, 1, 800) AS summary,
 CASE WHEN id % 2 = 0 THEN array_to_string(w[1:6][1:5], ' ') ELSE {_Q('2', '3')} END AS problems, CASE WHEN id % 3 = 0 OR {_Q('2', '5')} = '' THEN 'Unclear from evidence.' WHEN ends_with({_Q('2', '5')}, '.') THEN substring({_Q('2', '5')}, 1, 300) ELSE substring({_Q('2', '5')} || '.', 1, 300) END AS wedge,
 [0.5, 1, 0, 0.25, 0.5][id % 5 + 1]::DOUBLE AS confidence, CASE WHEN id % 2 = 0 OR {_Q('1', '3')} = '' THEN NULL ELSE {_Q('1', '3')} END AS connects_to FROM v_words WHERE id % 10 <> 9""")
def catalyst_answers(spark, sf):
    k = F.col("id")
    number = F.element_at(F.array(*[F.lit(x).cast("string") for x in (None, "1.7", "-0.5", "0.25", '"high"')]), (k % 5 + 1).cast("int"))
    one = _object(
        title=_js(_part(0, 40)), topic_tags=F.to_json(F.slice("w", 1, 7)), what_changed=_js(F.when(k % 4 == 0, "").otherwise(_part(3, 20))), summary=_js(_part(5, 6)), problems_created=F.when(k % 2 == 0, F.to_json(F.slice("w", 1, 6))).otherwise(_js(_part(2, 3))),
        opportunity_wedge=_js(F.when(k % 3 == 0, "").otherwise(_part(2, 5))), confidence=number, connects_to=_js(F.when(k % 2 == 0, " ").otherwise(_part(1, 3))), source_urls=F.lit('["http://1","http://2","http://3","http://4"]'),
    )
    # an answer that is no list has no catalysts
    answer = F.when(k % 10 == 9, F.concat(F.lit("Sorry: "), one)).otherwise(F.concat(F.lit("```json\n["), one, F.lit(", 5, \"x\"]\n```")))
    x = views.card_words(spark, sf).select("id", F.posexplode(normalise.catalysts(answer)).alias("ordinal", "c"))
    return x.select("id", "ordinal", "c.title", F.size("c.topic_tags").alias("n_tags"), "c.what_changed", "c.summary", normalise.problems_text(F.col("c.problems_created")).alias("problems"), F.col("c.opportunity_wedge").alias("wedge"), "c.confidence", "c.connects_to")


@query(_C + f"""SELECT id, title, CASE WHEN bad THEN 'old summary' WHEN thin THEN '' WHEN id % 4 = 0 THEN 'old summary' ELSE substring(s, 1, 1500) END AS summary, CASE WHEN bad THEN 'old why' WHEN thin THEN '' WHEN len(st) = 0 THEN 'old why' ELSE substring(array_to_string(st, ' '), 1, 500) END AS why, CASE WHEN bad OR thin THEN 0 ELSE len(st[1:5]) END::INT AS n_stakes, CASE WHEN NOT bad AND id % 2 = 0 THEN 'http://own' ELSE 'http://l1|http://l2|http://l3|http://l4|http://l5' END AS urls
 FROM (SELECT id, bad, thin, st, s, CASE WHEN bad THEN 'old' WHEN thin THEN 'Insufficient evidence' WHEN t = '' THEN 'old' ELSE substring(t, 1, 200) END AS title FROM (SELECT id, id % 10 = 9 AS bad, id % 7 = 3 AS thin, w[1:id % 8] AS st, {_Q('0', '30')} AS t, {_Q('1', '50')} AS s FROM v_words WHERE len(w) > 0 OR true))""".replace("WHEN id % 4 = 0 THEN 'old summary' ELSE", "WHEN id % 4 = 0 OR s = '' THEN 'old summary' ELSE"))
def summary_answers(spark, sf):
    k = F.col("id")
    made = _object(title=_js(F.when(k % 7 == 3, "Insufficient evidence").otherwise(_part(0, 30))), summary=F.when(k % 4 != 0, _js(_part(1, 50))), stakes=F.to_json(F.slice("w", F.lit(1), (k % 8).cast("int"))), example_urls=F.when(k % 2 == 0, F.lit('["http://own"]')))
    answer = F.when(k % 10 == 9, "not JSON").otherwise(made)
    links = F.array(*[F.lit(f"http://l{j}") for j in range(1, 8)])
    x = views.card_words(spark, sf).withColumn("s", normalise.cluster_summary(answer, F.lit("old"), F.lit("old summary"), F.lit("old persona"), F.lit("old why"), links))
    return x.select("id", "s.title", "s.summary", F.col("s.why_matters").alias("why"), F.size("s.stakes").alias("n_stakes"), F.array_join("s.example_urls", "|").alias("urls"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 9 THEN CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(range(least(n, 5)), lambda i: 'v' || i), ',') END ELSE array_to_string(list_transform(list_filter([2, 0, 9, 2], lambda i: i < n), lambda i: 'v' || i), ',') END AS pain,
 CASE WHEN doc_id % 10 = 9 THEN 3 ELSE 1 END::INT AS n_catalysts, CASE WHEN doc_id % 10 = 9 THEN 0 ELSE 1 END::INT AS n_rejects FROM (SELECT doc_id, (doc_id % 8)::INT AS n FROM documents)""")
def gate_answers(spark, sf):
    """Positions chosen by an answer, some out of bounds or repeated, applied to a list."""
    k, n = F.col("doc_id"), (F.col("doc_id") % 8).cast("int")
    answer = F.when(k % 10 == 9, "none").otherwise('{"selected_pain_indices": [2, 0.0, 9, -1, 2, null], "selected_catalyst_indices": [1], "rejects": [{"kind": "pain", "index": 1, "reason": "news_only"}]}')
    known = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("v"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    x = views.table(spark, sf, "documents").select(k.alias("id"), known.alias("known"), normalise.gate_answer(answer, n, F.lit(4)).alias("g"))
    return x.select("id", F.array_join(normalise.picked(F.col("known"), F.col("g.pain")), ",").alias("pain"), F.size("g.catalysts").alias("n_catalysts"), F.size("g.rejects").alias("n_rejects"))


@query(_C + f"SELECT id, CASE WHEN id % 4 = 0 OR id % 5 = 0 OR id % 7 = 0 OR {_Q('0', '40')} = '' THEN 'old' ELSE substring({_Q('0', '40')}, 1, 200) END AS title FROM v_words")
def new_titles(spark, sf):
    k = F.col("id")
    answer = F.when(k % 4 == 0, "no").when(k % 5 == 0, '{"new_title": "  "}').otherwise(_object(new_title=_js(_part(0, 40))))
    snippets = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))
    return views.card_words(spark, sf).select("id", normalise.new_title(answer, F.lit("old"), snippets).alias("title"))


_AFF = f"CASE WHEN id % 4 = 0 THEN CASE WHEN pays <> '' THEN pays WHEN icp <> '' THEN icp ELSE 'Engineering teams' END ELSE 'Platform team' END"


@query(_C + f"""SELECT id, substring({_Q('0', '40')}, 1, 200) AS title, substring({_AFF}, 1, 300) AS who_is_affected, substring({strip(_Q('1', '4'))}, 1, 200) || '>http://p>' || CASE WHEN id % 2 = 0 THEN '{HN}' || id ELSE '-' END || '|' || substring({strip(_Q('2', '3'))}, 1, 200) || '>->-|three>->{HN}9' AS evidence,
 'low' AS confidence, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END::INT AS n_warnings FROM (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE substring({strip(_Q('2', '2'))}, 1, 200) END AS pays, CASE WHEN id % 8 = 0 THEN '' ELSE 'the icp' END AS icp FROM v_words) WHERE id % 10 <> 9""")
def card_answers(spark, sf):
    """Cards of an answer: evidence as objects or bare quotes, inferred roles, confidence by comment links."""
    k, num = F.col("id"), F.col("id").cast("string")
    entry = lambda quote, post, comment: _object(quote=_js(quote), post_url=post, comment_url=comment)
    e1 = entry(F.concat(F.lit(" "), _part(1, 4)), F.lit('" http://p "'), F.when(k % 2 == 0, F.concat(F.lit(f'"{HN}'), num, F.lit('"'))).otherwise(F.lit('""')))
    e3 = entry(F.lit("three"), F.lit("null"), F.lit(f'"{HN}9"'))
    one = _object(
        title=_js(_part(0, 40)), evidence=F.concat(F.lit("["), e1, F.lit(","), _js(F.concat(_part(2, 3), F.lit(" "))), F.lit(","), e3, F.lit("]")), who_pays=_js(F.when(k % 3 == 0, "").otherwise(_part(2, 2))),
        who_is_affected=F.when(k % 4 == 0, F.lit('"Developers"')).otherwise(F.lit('" Platform team"')), wedge=_object(icp=F.when(k % 8 == 0, F.lit('""')).otherwise(F.lit('"the icp"'))), confidence=F.lit('"MED"'),
    )
    answer = F.when(k % 10 == 9, one).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    x = views.card_words(spark, sf).select("id", F.explode(normalise.cards(answer)).alias("c"))
    shown = F.transform("c.evidence", lambda e: F.concat_ws(">", e["quote"], F.coalesce(e["post_url"], F.lit("-")), F.coalesce(e["comment_url"], F.lit("-"))))
    return x.select("id", "c.title", "c.who_is_affected", F.array_join(shown, "|").alias("evidence"), "c.confidence", F.size("c.card_warnings").alias("n_warnings"))


_IDEA = lambda t, claim, urls: lines(f"['### **{t}**', '', 'hook', '', 'it happened', '', '**Pain signal:** {claim}', 'Evidence: s1; s2']", f"list_transform(list_filter({urls}, lambda u: u <> ''), lambda u: '- ' || u)", "['', '- now', '', '**Wedge:** ' || CASE WHEN id % 2 = 0 THEN 'Build it.' ELSE 'Unclear from evidence.' END, '', '**Confidence:** ' || CASE WHEN id % 4 = 0 THEN '0.50' ELSE '1.00' END, '']")
_U1, _U2, _U3 = "['http://a', '', 'http://' || (id % 3)]", "['http://' || (id % 2)]", "['http://a']"


@query(f"""SELECT doc_id AS id, array_to_string([x for x in [{_IDEA('One', 'c1', _U1)}, CASE WHEN id % 3 <> id % 2 THEN {_IDEA('Theme', 'c2', _U2)} END] if x IS NOT NULL], '=') AS markdown FROM (SELECT doc_id, doc_id AS id FROM documents)""")
def idea_cards(spark, sf):
    """Idea cards of an answer as markdown; the second goes if it repeats a link of the first, the third always does."""
    k = F.col("doc_id")
    num = lambda n: F.concat(F.lit('"http://'), (k % n).cast("string"), F.lit('"'))
    signal = lambda claim, *urls: _object(claim=F.lit(f'"{claim}"'), evidence_snippets=F.lit('["s1","s2"]'), links=F.concat(F.lit("["), F.concat_ws(",", *urls), F.lit("]")))
    one = lambda title, pain: _object(idea_title=F.lit(f'"{title}"'), hook=F.lit('"hook"'), what_happened=F.lit('"it happened"'), pain_signal=pain, why_now=F.lit('["now",""]'), wedge=F.when(k % 2 == 0, F.lit('"Build it"')).otherwise(F.lit('""')), confidence=F.when(k % 4 == 0, F.lit('"?"')).otherwise(F.lit("3")))
    answer = F.concat(F.lit("["), F.concat_ws(",", one("One", signal("c1", F.lit('"http://a"'), F.lit('""'), num(3))), one("", signal("c2", num(2))), one("Three", signal("c3", F.lit('"http://a"')))), F.lit("]"))
    x = views.table(spark, sf, "documents").select(k.alias("id"), normalise.idea_cards(answer).alias("c"))
    return x.select("id", F.array_join(F.transform("c", render.idea_markdown), "=").alias("markdown"))


_VALID = "Builders keep losing hours to flaky tests every week"


@query(_C + f", src AS (SELECT {_DRAFT_COLS} FROM v_cards), made AS ({_plain('src')}) SELECT id, CASE WHEN id % 3 = 2 THEN hook ELSE {literal(_VALID)} END AS hook, CASE id % 3 WHEN 0 THEN 'http://b' WHEN 1 THEN 'http://a||http://b' ELSE 'http://a||http://b' END AS links, CASE WHEN id % 3 = 2 THEN grade WHEN id % 3 = 1 THEN 'Low' ELSE grade END AS grade FROM made")
def template_items(spark, sf):
    """Items rewritten by a model: the first answer that is valid, else one made of the draft."""
    k = F.col("id")
    good = lambda links, grade: F.concat(F.lit(f'{{"hook": "{_VALID}", "explanation": "It hurts.", "why_bullets": ["why"], "who": "Teams", "wedge": "Fix it", "evidence_snippets": ["flaky again"], "links": {links}'), F.lit(f', "strength_or_impact": "{grade}"}}'))
    short = F.lit('{"hook": "too short", "links": []}')
    answers = F.when(k % 3 == 0, F.array(F.concat(F.lit("```json"), good('["http://z", "http://b"]', "odd"), F.lit("```")), short)).when(k % 3 == 1, F.array(short, good('["http://z"]', "Low"))).otherwise(F.array(F.lit("?"), short))
    x = _drafts(spark, sf).withColumn("i", normalise.template_item(answers, F.col("draft"), F.col("found"), F.col("grade")))
    return x.select("id", "i.hook", F.array_join("i.links", "|").alias("links"), F.col("i.strength_or_impact").alias("grade"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'Worth exploring: re-run with more data.' ELSE 'Teams will ' || doc_id END AS bet FROM documents")
def bet_lines(spark, sf):
    k = F.col("doc_id")
    answer = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("\n Teams will "), k.cast("string"), F.lit("  \nmore")))
    return views.table(spark, sf, "documents").select(k.alias("id"), normalise.bet_line(answer, (k % 3).cast("int")).alias("bet"))


@query(_P + f", {_BULLETS} SELECT p.id, coalesce(x, '(no structured evidence)') AS prompt FROM v_posts p LEFT JOIN (SELECT id, string_agg('- \"' || quote || '\" — Post: ' || coalesce(nullif(c.post_url, ''), own) || ' — Comment: ' || coalesce(c.comment_url, '(none)'), chr(10) ORDER BY n) AS x FROM b GROUP BY 1) USING (id)")
def prompt_evidence(spark, sf):
    item = F.struct("source", "source_id", "url", "evidence_snippets", "comments")
    return posts(spark, sf).select("id", render.prompt_bullets(evidence.bullets(item)).alias("prompt"))


# ---- payloads of clusters

_MEMBERS = "m AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS o FROM v_posts)"


@query(
    _P + f""", {_MEMBERS}, {_BULLETS}, s AS (SELECT cluster, list(s ORDER BY o, n)[1:10] AS l FROM (SELECT cluster, o, generate_subscripts(evidence_snippets, 1) AS n, unnest(evidence_snippets) AS s FROM m) GROUP BY 1),
 u AS (SELECT cluster, list(url ORDER BY o)[1:5] AS l FROM m WHERE coalesce(url, '') <> '' GROUP BY 1), tg AS (SELECT cluster, list(t ORDER BY pos_)[1:10] AS l FROM (SELECT cluster, t, min(o * 10 + n) AS pos_ FROM (SELECT cluster, o, generate_subscripts(topic_tags, 1) AS n, unnest(topic_tags) AS t FROM m) GROUP BY ALL) GROUP BY 1),
 bl AS (SELECT cluster, list(quote || '>' || coalesce(c.comment_url, '') ORDER BY o, b.n)[1:15] AS l FROM b JOIN m USING (id) WHERE o < 15 GROUP BY 1), f AS (SELECT DISTINCT cluster FROM m)
 SELECT cluster, array_to_string(coalesce(s.l, []), '|') AS snippets, array_to_string(coalesce(u.l, []), '|') AS links, array_to_string(coalesce(tg.l, []), '|') AS tags, array_to_string(coalesce(bl.l, []), '|') AS bullets FROM f LEFT JOIN s USING (cluster) LEFT JOIN u USING (cluster) LEFT JOIN tg USING (cluster) LEFT JOIN bl USING (cluster)"""
)
def cluster_payloads(spark, sf):
    p = posts(spark, sf)
    members = p.withColumns({"cluster_id": F.col("cluster").cast("string"), "ordinal": F.row_number().over(Window.partitionBy("cluster").orderBy("id")) - 1}).drop("topic_tags")
    clusters = p.select("cluster").distinct().select(F.col("cluster").cast("string").alias("id"), F.col("cluster").alias("cluster_index"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.array().cast("array<string>").alias("example_urls"))
    out = report.cluster_payloads(clusters, members, p.select("id", "topic_tags"))
    return out.select(F.col("cluster_index").alias("cluster"), F.array_join("snippets", "|").alias("snippets"), F.array_join("links", "|").alias("links"), F.array_join("topic_tags", "|").alias("tags"), F.array_join(F.transform("bullets", lambda b: F.concat(b["quote"], F.lit(">"), F.coalesce(b["comment_url"], F.lit("")))), "|").alias("bullets"))


@query(_P + f"SELECT id, array_to_string(list_distinct_kept, '|') AS urls FROM (SELECT id, [x for x in [coalesce(url, ''), 'http://k/' || (id % 3), CASE WHEN id % 2 = 0 THEN coalesce(url, '') ELSE '' END] if x <> ''] AS l, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_kept FROM v_posts)")
def allowed_urls(spark, sf):
    k = F.col("id")
    bullet = F.struct(F.concat(F.lit(" http://k/"), (k % 3).cast("string")).alias("post_url"), F.when(k % 2 == 0, F.col("url")).alias("comment_url"))
    payload = F.struct(F.array("url").alias("links"), F.array(bullet).alias("bullets"))
    return posts(spark, sf).select("id", F.array_join(report.allowed_urls(F.array(payload)), "|").alias("urls"))


@query(_LABELLED + "SELECT i.id, coalesce(label IN ('PAIN', 'DISCUSSION'), false) AS eligible, NOT (contains(lower(p.text), 'unclear from evidence') OR contains(lower(p.text), 'not enough evidence')) AS has_summary FROM v_items i JOIN v_labels l USING (id) JOIN (SELECT id, text || CASE WHEN id % 5 = 0 THEN ' Unclear from Evidence' ELSE '' END AS text FROM v_posts) p USING (id)")
def report_filters(spark, sf):
    x = posts(spark, sf).join(views.labels(spark, sf).select("id", "label"), "id")
    told = F.concat("text", F.when(F.col("id") % 5 == 0, " Unclear from Evidence").otherwise(""))
    return x.select("id", report.eligible(F.col("label")).alias("eligible"), report.has_summary(told).alias("has_summary"))
