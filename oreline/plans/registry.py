"""Registered queries and their SQL; small helpers to write both."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return str(v)


# ---- SQL text of the text primitives


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '[\s\p{{Z}}]+'), lambda w_: w_ <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def first_words(x: str, n: int = 12) -> str:
    return f"array_to_string(({words(x)})[1:{n}], ' ')"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def has_any(x: str, lexicon: list[str]) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), {literal('|'.join(re.sub(r'([!-/:-@\[-`{-~])', r'\\\1', w) for w in lexicon))})"


def n_contained(x: str, lexicon: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce({x}, '')), {literal(w)})::INT" for w in lexicon) + ")"


def some(*cases: tuple[str, str]) -> str:
    """The messages whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {literal(m)} END" for c, m in cases) + "], lambda m_: m_ IS NOT NULL)"


def lines(*parts: str) -> str:
    """Lists of lines, one below the other."""
    return "array_to_string(" + " || ".join(parts) + ", chr(10))"
