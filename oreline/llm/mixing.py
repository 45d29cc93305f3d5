"""Mixing sources to target weights by iterative proportional fitting.

Method.  Tokens are summed per cell of source, language and topic.  Raking
scales the cells' probabilities to each margin's targets in turn, none above 1.
The first PUSHED rounds aim at the wanted share of all tokens; in the others,
what the bound takes off lowers the share that is kept instead of shifting the
margins, so these hold to about 1e-5 where the cells allow it at all.  A document is then kept with its cell's probability.  The draw is a hash
of the id, so it is the same in every run.

The topic of a text is decided by all its words of five or more letters: each
distinct one, in lower case, votes for the topic that its hash names, and the
topic with most votes wins (the lesser of equal ones).  A text without such
words has no topic.

Categories without a target form 'other', which keeps its observed share, so
there are at most (sources + 1) * (languages + 1) * (topics + 1) cells whatever
the corpus; only these reach the driver.  Targets of categories that the corpus
lacks are spread over the others.  Tokens are words ``[^\\x20\\x09-\\x0D]+``.

Defined cases.  Null text has no tokens and weighs nothing, but is drawn like
the rest of its cell; a cell without any token is drawn at the share to keep.
Null source or language is 'other'.  Repeated rows have one draw.  An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, text_of

TOPICS, PUSHED, ROUNDS = 8, 40, 70

Cell = tuple[str, str, str]


@dataclass(frozen=True)
class Targets:
    """Target shares of the tokens, per margin, and the share of all tokens to keep at most."""

    source: dict = field(default_factory=lambda: {f"src{i}": 0.05 for i in range(20)})
    lang: dict = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict = field(default_factory=lambda: {str(i): 1 / TOPICS for i in range(TOPICS)})
    keep: float = 0.6


def topic_of(text: Column) -> Column:
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}{5,}"), F.lit(0)), F.lower))
    votes = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("long") % TOPICS).cast("int"))
    return F.transform(F.array(votes), lambda v: F.when(F.size(v) > 0, _most(v)).otherwise(F.lit("other")))[0]


def _most(votes: Column) -> Column:
    counts = F.transform(F.sequence(F.lit(0), F.lit(TOPICS - 1)), lambda k: F.size(F.filter(votes, lambda x: x == k)))
    return F.transform(F.array(counts), lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("string"))[0]


def draw_of(id_col: str | Column) -> Column:
    """A number from 0 to below 1 that the id decides."""
    name = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _category(column: Column, known: dict) -> Column:
    return F.when(column.isin(list(known)), column).otherwise(F.lit("other"))


def _shares(cells: dict[Cell, float], i: int) -> dict[str, float]:
    out: dict[str, float] = {}
    for c, n in cells.items():
        out[c[i]] = out.get(c[i], 0.0) + n
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def goals(cells: dict[Cell, int], targets: Targets) -> list[dict[str, float]]:
    """The share of the tokens that each category of each margin is to have."""
    margins = []
    for i, wanted in enumerate((targets.source, targets.lang, targets.topic)):
        have = _shares(cells, i)
        other = have.get("other", 0.0)
        listed = sum(v for k, v in wanted.items() if k in have)
        margins.append({k: other if k == "other" else (1 - other) * wanted[k] / listed for k in have})
    return margins


def rake(cells: dict[Cell, int], targets: Targets) -> dict[Cell, float]:
    """The probability of each cell with tokens."""
    cells = {c: n for c, n in cells.items() if n}
    if not cells:
        return {}
    n = np.array(list(cells.values()), dtype=np.float64)
    margins = []
    for i, goal in enumerate(goals(cells, targets)):
        names = {k: j for j, k in enumerate(goal)}
        margins.append((np.array([names[c[i]] for c in cells]), np.array(list(goal.values()))))
    p = np.full(len(n), targets.keep)
    for k in range(ROUNDS):
        for at, goal in margins:
            now = np.bincount(at, n * p, len(goal))
            aim = targets.keep * n.sum() if k < PUSHED else (n * p).sum()
            p = np.minimum(1.0, p * (goal[at] * aim / now[at]))
    return dict(zip(cells, p.tolist(), strict=True))


def expected_shares(cells: dict[Cell, int], chance: dict[Cell, float], targets: Targets) -> list[dict[str, tuple[float, float]]]:
    """Per margin and category the target share and the expected share of the kept tokens."""
    real = {c: n for c, n in cells.items() if n}
    kept = {c: n * chance[c] for c, n in real.items()}
    return [{k: (goal[k], have[k]) for k in goal} for goal, have in ((g, _shares(kept, i)) for i, g in enumerate(goals(real, targets)))]


def mix(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(row, topic, tokens, probability) of the sampled rows; ``row`` holds all columns of docs, whatever their names."""
    targets = targets or Targets()
    text = text_of(text_col)
    marks = {
        "draw": draw_of(id_col), "topic": topic_of(text), "tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "mix_source": _category(F.col(source_col), targets.source), "mix_lang": _category(F.col(lang_col), targets.lang),
    }
    steps = Steps(docs.sparkSession, "mixing")
    # the votes cost more than a copy of the texts, so they are counted once
    marked = steps.write(docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in marks.items()]), "marked")
    keys = ["mix_source", "mix_lang", "topic"]
    sums = marked.groupBy(*keys).agg(F.sum("tokens").alias("n"))
    chance = rake({(r[0], r[1], r[2]): r[3] for r in sums.orderBy(*keys).collect()}, targets)
    table = docs.sparkSession.createDataFrame([(*c, p) for c, p in chance.items()], "mix_source string, mix_lang string, topic string, p double")
    # a row per cell, bounded by the targets
    out = marked.join(F.broadcast(table), keys, "left").withColumn("probability", F.coalesce("p", F.lit(targets.keep)))
    return out.where(F.col("draw") < F.col("probability")).select("row", "topic", "tokens", "probability")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", F.round("probability", 6).alias("probability"))


def _sql() -> str:
    """The same for DuckDB, its rounds unrolled."""
    t = Targets()
    values = lambda d: ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in d.items())
    parts = [
        f"docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, CASE WHEN source IN ({', '.join(map(repr, t.source))}) THEN source ELSE 'other' END AS s, CASE WHEN lang IN ({', '.join(map(repr, t.lang))}) THEN lang ELSE 'other' END AS l FROM documents)",
        rf"votes AS (SELECT *, list_transform(list_distinct(list_transform(regexp_extract_all(t, '\p{{L}}{{5,}}'), lambda w: lower(w))), lambda w: (('0x' || substr(md5(w), 1, 6))::BIGINT) % {TOPICS}) AS v FROM docs)",
        f"counted AS (SELECT *, list_transform(range({TOPICS}), lambda k: len(list_filter(v, lambda x: x = k))) AS c FROM votes)",
        r"marked AS MATERIALIZED (SELECT doc_id, source, lang, s, l, CASE WHEN len(v) = 0 THEN 'other' ELSE (list_position(c, list_max(c)) - 1)::VARCHAR END AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM counted)",
        f"w0 AS MATERIALIZED (SELECT s, l, topic, sum(tokens)::DOUBLE AS n, {t.keep}::DOUBLE AS p FROM marked GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for k, (name, d) in {"s": ("source", t.source), "l": ("lang", t.lang), "topic": ("topic", t.topic)}.items():
        parts += [
            f"have_{name} AS (SELECT {k} AS k, sum(n) / (SELECT sum(n) FROM w0) AS share FROM w0 GROUP BY 1)",
            f"goal_{name} AS MATERIALIZED (SELECT h.k, CASE WHEN h.k = 'other' THEN share ELSE (1 - coalesce((SELECT share FROM have_{name} WHERE k = 'other'), 0)) * v.g / (SELECT sum(g) FROM (VALUES {values(d)}) AS x(k, g) WHERE k IN (SELECT k FROM have_{name})) END AS goal FROM have_{name} h LEFT JOIN (VALUES {values(d)}) AS v(k, g) ON h.k = v.k)",
        ]
    i = 0
    for r in range(ROUNDS):
        aim = f"{t.keep} * sum(n) OVER ()" if r < PUSHED else "sum(n * p) OVER ()"
        for k, name in (("s", "source"), ("l", "lang"), ("topic", "topic")):
            parts.append(f"w{i + 1} AS MATERIALIZED (SELECT s, l, topic, n, least(1.0, p * (goal * ({aim}) / sum(n * p) OVER (PARTITION BY w{i}.{k}))) AS p FROM w{i} JOIN goal_{name} g ON g.k = w{i}.{k})")
            i += 1
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, m.topic, tokens, round(coalesce(p, {t.keep}), 6) AS probability FROM marked m LEFT JOIN w{i} w ON m.s = w.s AND m.l = w.l AND m.topic = w.topic "
        f"WHERE (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) / 4503599627370496.0 < coalesce(p, {t.keep})"
    )


SQL = _sql()
