"""Text primitives as Column expressions: words, sentences, substring lexicons, ordered sets."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
BLANKS = r"[\s\p{Z}]+"
#: The same characters one by one.
BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def nz(c: Column, default) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def words(c: Column) -> Column:
    """White-space separated words; none for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANKS), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def sentences(c: Column, lexicon: list[str] | None = None) -> Column:
    """Rough sentences of more than ten characters, or those of them that hold a word of the lexicon; a line end also ends a sentence.

    The lexicon, whose words neither begin nor end with a blank, is looked for before anything else is done to a sentence.
    """
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(". ")), r"[.!?]\s+")
    if lexicon:
        parts = F.filter(parts, lambda s: contains_any(s, lexicon))
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 10)


@functools.cache
def alternation(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words: they are laid into a prefix tree, so a place in the text is left at the first character that begins none."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:  # a shorter word is found first
            return ""
        parts = [_quoted(c) + pattern(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    first = "".join(_quoted(c) for c in sorted(tree))
    return (f"(?=[{first}])" if len(tree) > 1 and "" not in tree else "") + pattern(tree)


def _quoted(c: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", c)


def contains_any(c: Column, lexicon: list[str]) -> Column:
    """Whether the lower-cased text holds one of the substrings, in one pass."""
    return F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit(alternation(tuple(lexicon))))


def count_contained(c: Column, lexicon: list[str]) -> Column:
    """How many of the substrings the lower-cased text holds."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in lexicon), F.lit(0))


def count_matched(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns match the lower-cased text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((F.regexp_like(low, F.lit(p)).cast("int") for p in patterns), F.lit(0))


def distinct_ignoring_case(a: Column, most: int = 1 << 30) -> Column:
    """The first of the elements that are equal in lower case, in order, up to ``most``."""
    return F.aggregate(a, F.array().cast("array<string>"), lambda seen, s: F.when((F.size(seen) >= most) | F.exists(seen, lambda x: F.lower(x) == F.lower(s)), seen).otherwise(F.array_append(seen, s)))


def first_n(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def messages(*conditions: tuple[Column, str]) -> Column:
    """The messages whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in conditions]))


def is_day(c: Column) -> Column:
    """Whether a text is a calendar day written as yyyy-MM-dd."""
    return F.coalesce(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))
