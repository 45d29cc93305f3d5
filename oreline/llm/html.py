"""HTML extraction: site templates found by counting hashed element subtrees.

Method.  A page is parsed once into a tree of elements.  Each block element's
subtree has a hash of its tag and its text, without attributes, scripts or
styles.  The hashes of the whole body, menus and footers included, are counted
per host in Spark, once a page; a subtree that recurs on at least MIN_PAGES
pages and on a share of MIN_SHARE of a host's pages is part of the site's
template, and the blocks inside are deleted.

Only after that, what no other page shows to be a template is left out by rule:
elements that never belong to an article by tag, role or class name (see NEVER
and NAMED), and all outside the main part of the page.  The main part is the
page's ``article`` or ``main`` element or one with such a role or class, else
its body.  A subtree of the main part needs MAIN_SHARE of the pages, so that
short lines which articles have in common stay.

A page whose blocks would all be deleted keeps those of its main part, so pages
that are copies of each other keep their article.

Defined cases.  Null html is empty, its text ''.  Pages without a host form
one host ''.  A repeated page_id is a page of its own.  Markup that never
closes ends with the page.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, kind_of

MIN_PAGES, MIN_SHARE, MAIN_SHARE = 4, 0.05, 0.5

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style title head nav header footer aside form noscript template iframe button select option textarea input label svg canvas object embed audio video map dialog menu datalist".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"} | {"nav", "header", "footer", "aside", "form"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
UNSEEN = frozenset("script style head noscript template".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager skip toolbar copyright legal".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN_NAMES = frozenset("article post entry content main story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z0-9]+")
_WHITE = re.compile(r"\s+")


class Element:
    """``mark`` is the hash of its subtree."""

    __slots__ = ("tag", "attrs", "parts", "parent", "mark")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent, self.mark = tag, attrs, parent, 0
        self.parts: list = []


def parse(page: str) -> Element:
    """The tree of a page; texts are kept undecoded."""
    root = node = Element("#page", "", None)
    at, end = 0, len(page)
    lower = None
    token, find = _TOKEN.match, page.find
    every = [root]

    while at < end:
        here = find("<", at)
        if here != at:
            here = end if here < 0 else here
            node.parts.append(page[at:here])
            at = here
            continue
        m = token(page, at)
        at = m.end()
        closing, name, attrs = m.groups()
        if name is None:
            if at - here == 1:
                node.parts.append("<")
            continue
        name = name.lower()
        if closing:
            up = node
            while up is not None and up.tag != name:
                up = None if up.tag in ("td", "th") and name not in BLOCK else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if name in CLOSES_P:
            up = node
            while up.tag != "p" and up.tag not in BLOCK and up.parent is not None:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        elif name in CLOSED_BY:
            up = node
            while up.parent is not None and up.tag not in CLOSED_BY[name] and up.tag not in SCOPES[name]:
                up = up.parent
            if up.tag in CLOSED_BY[name]:
                node = up.parent
        new = Element(name, attrs, node)
        node.parts.append(new)
        every.append(new)
        if name in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find("</" + name, at)
            stop = end if stop < 0 else stop
            new.parts.append(page[at:stop])
            at = find(">", stop) + 1 or end
        elif name not in VOID and not attrs.endswith("/"):
            node = new
    # those that began later lie inside or behind, so the last come first
    for e in reversed(every):
        inside = "\x1f".join([x if x.__class__ is str else x.mark for x in (" ".join(p.split()) if p.__class__ is str else p for p in e.parts) if x] if e.tag not in UNSEEN else ())
        e.mark = xxhash.xxh64_hexdigest(f"{e.tag}\x1e{inside}".encode("utf-8", "replace"))
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(raw)}


def never(e: Element) -> bool:
    """Whether an element is outside any article by its tag, role, class or visibility."""
    if e.tag in NEVER:
        return True
    if not e.attrs or e.tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(e.attrs)
    names = [w for k in ("class", "id") if k in a for w in a[k].split()]
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or "display:none" in a.get("style", "").replace(" ", "") or any(set(_NAME.findall(w)) & NAMED for w in names)


def _has_text(parts: list[Element]) -> bool:
    todo: list = list(parts)
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            if not e.isspace():
                return True
        elif not never(e) or e in parts:
            todo += e.parts
    return False


def main_parts(root: Element) -> list[Element]:
    """The outermost article elements; else main elements; else elements named so; else the body; else the page."""
    found: dict[str, list[Element]] = {"article": [], "main": [], "named": [], "body": []}
    for kind in found:
        todo = [root]
        while todo:
            e = todo.pop()
            if kind != "body" and e is not root and never(e):
                continue
            a = _attributes(e.attrs) if kind in ("main", "named") and e.attrs else {}
            if e.tag == kind or kind == "main" and a.get("role") in ("main", "article") or kind == "named" and e.tag in ("div", "section", "td") and MAIN_NAMES & {w for k in ("class", "id") for n in a.get(k, "").split() for w in _NAME.findall(n)}:
                found[kind].append(e)
                continue
            todo += [y for y in reversed(e.parts) if isinstance(y, Element)]
        if _has_text(found[kind]):
            return found[kind]
    return [root]


def _walk(part: Element, ruled: bool, aside: list[Element] | None) -> list[tuple[str, list[int], bool]]:
    """Blocks of text below an element, each with the hashes of the block subtrees around it.  Elements never in an article go to ``aside``, if there is one."""
    blocks: list[tuple[str, list[int], bool]] = []
    line: list[str] = []
    path: list[int] = [int(part.mark, 16) >> 1] if ruled else []

    def flush() -> None:
        if line:
            s = "".join(line)
            s = " ".join((entities.unescape(s) if "&" in s else s).split())
            if s:
                blocks.append((s, path.copy(), ruled))
            line.clear()

    todo: list = list(reversed(part.parts))
    while todo:
        e = todo.pop()
        if e.__class__ is str:
            line.append(e)
        elif e is None:
            flush()
            path.pop()
        elif aside is not None and never(e):
            if e.tag in BLOCK or e.tag in NEVER:
                flush()
            aside.append(e)
        elif e.tag in UNSEEN:
            continue
        elif e.tag == "br":
            line.append(" ")
        elif e.tag in BLOCK or ruled and e.tag in NEVER:
            flush()
            path.append(int(e.mark, 16) >> 1)
            todo.append(None)
            todo += reversed(e.parts)
        else:
            todo += reversed(e.parts)
    flush()
    return blocks


def _outside(root: Element, parts: list[Element]) -> list[Element]:
    """The largest elements that neither hold nor lie in one of ``parts``."""
    holders = {id(root)}
    for e in parts:
        while e is not None:
            holders.add(id(e))
            e = e.parent
    mains, out, todo = {id(e) for e in parts}, [], [root]
    while todo:
        e = todo.pop()
        if id(e) not in holders:
            out.append(e)
        elif id(e) not in mains:
            todo += [x for x in reversed(e.parts) if x.__class__ is not str]
    return out


def blocks_of(page: str) -> list[tuple[str, list[int], bool]]:
    """Blocks of text of the whole page, each with the hashes of the block subtrees around it, and whether a rule leaves it out; the others are in page order."""
    root = parse(page)
    parts = main_parts(root)
    blocks, aside = [], _outside(root, parts)
    for part in parts:
        blocks += _walk(part, False, aside)
    for e in aside:
        if e.tag not in UNSEEN:
            blocks += _walk(e, True, None)
    return blocks


def host_of(url):
    """The host of a URL in lower case, without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks): the blocks of every page, each with its hashes and whether a rule leaves it out; texts only of the others."""
    kind = kind_of(pages, "page_id")
    arrow = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64())), ("ruled", pa.bool_())]))

    def run(batches):
        for batch in batches:
            out = [[{"text": None if r else t, "path": p, "ruled": r} for t, p, r in blocks_of(page or "")] for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(out, arrow)], ["page_id", "url", "host", "blocks"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, blocks array<struct<text: string, path: array<bigint>, ruled: boolean>>")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """(host, hash, main) of the subtrees of parsed pages that recur on many pages of their host; main: on enough to be deleted from main parts too.  Counts are summed before rows are moved."""
    n = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    own = pages.select("host", F.explode(F.array_distinct(F.flatten(F.col("blocks.path")))).alias("hash"))
    often = own.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(n, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "hash", (F.col("n") >= F.col("pages") * main_share).alias("main"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_template, n_rule) of every page: its main text, and how many blocks were deleted by counting and, of the rest, by rule."""
    steps = Steps(pages.sparkSession, "html")
    rows = steps.write(parsed(pages), "parsed")
    found = templates(rows, min_pages, min_share, main_share).groupBy("host").agg(F.collect_list("hash").alias("template"), F.collect_list(F.when(F.col("main"), F.col("hash"))).alias("strict"))
    found = steps.write(found, "templates")
    none = F.array().cast("array<bigint>")
    joined = rows.join(found, "host", "left").withColumns({"template": F.coalesce("template", none), "strict": F.coalesce("strict", none)})
    recurs = lambda b: F.arrays_overlap(b["path"], F.when(b["ruled"], F.col("template")).otherwise(F.col("strict")))
    left = joined.withColumn("left", F.filter("blocks", lambda b: ~recurs(b)))
    text = F.filter("left", lambda b: ~b["ruled"])["text"]
    whole = F.filter("blocks", lambda b: ~b["ruled"])["text"]
    text = F.when(F.size(text) > 0, text).otherwise(whole)
    return left.select("page_id", "url", F.array_join(text, "\n").alias("text"), (F.size("blocks") - F.size("left")).alias("n_template"), F.size(F.filter("left", lambda b: b["ruled"])).alias("n_rule"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
