"""The boundary to language models: one call interface, a deterministic stand-in, normalisers and fallbacks."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import lexicons as L
from ..functions.answers import number_of, text_of, texts_of, with_object
from ..functions.normalise import unfenced
from ..functions.scoring import unit
from ..functions.text import first_n, first_words, strip

log = logging.getLogger(__name__)


class RateLimited(Exception):
    """The model asks to wait; the only failure that is tried again."""


class ModelProvider(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StubProvider:
    """Labels and vectors decided by a hash of the text, for tests and runs without a model."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            h = hashlib.blake2b(p.encode(), digest_size=8).digest()
            out.append(json.dumps({"label": L.LABELS[h[0] % 4], "confidence": h[1] / 255, "audience_fit": h[2] / 255, "pain_intensity": h[3] / 255, "actionability": h[4] / 255}))
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[x / 255 for x in hashlib.blake2b(t.encode(), digest_size=8).digest()] for t in texts]


def _answers(model: ModelProvider, prompts: list[str], attempts: int, pause: float) -> list[str | None]:
    """Answers, null after the last attempt; waits ``pause`` times 2, 4, 8 where the model asks to, and tries nothing else again."""
    for k in range(attempts):
        try:
            return [a.strip() if a else "" for a in model.generate(prompts)]
        except RateLimited:
            time.sleep(pause * 2 ** (k + 1))
        except Exception:
            log.warning("the model failed", exc_info=True)
            break
    return [None] * len(prompts)


def generate(df: DataFrame, prompt: str, answer: str, provider: Callable[[], ModelProvider], attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """df with the model's answer as a column; null where it failed.  One provider a task; filter before this, Catalyst can't look inside."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            yield pdf.assign(**{answer: _answers(model, pdf[prompt].tolist(), attempts, pause)})[[*names, answer]]

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(answer, StringType())]))


def embed(df: DataFrame, text: str, vector: str, provider: Callable[[], ModelProvider], sizes: tuple[int, ...] = (50, 16, 4)) -> DataFrame:
    """df with a vector per text (its first 8000 characters); null where every request size failed.

    A batch is asked for in requests of the first size, and anew from its beginning in smaller ones after a failure.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            texts = [(t or "")[:8000] for t in pdf[text]]
            out: list = [None] * len(texts)
            for size in sizes:
                try:
                    out = [v for k in range(0, len(texts), size) for v in model.embed(texts[k : k + size])]
                    break
                except Exception:
                    log.warning("no vectors by %s", size, exc_info=True)
            yield pdf.assign(**{vector: out})[[*names, vector]]

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(vector, ArrayType(DoubleType()))]))


def label_lines(c: Column) -> Column:
    """struct(label, confidence) of a two-line answer: the first known label and the first number from 0 to 1."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    known = F.filter(F.transform(lines, F.upper), lambda x: x.isin(L.LABELS))
    numbers = F.filter(F.transform(lines, lambda x: x.try_cast("double")), lambda v: v.between(0, 1))
    return F.struct(F.coalesce(F.get(known, F.lit(0)), F.lit("OTHER")).alias("label"), F.coalesce(F.get(numbers, F.lit(0)), F.lit(0.5)).alias("confidence"))


def label_answer(c: Column) -> Column:
    """The normalised struct of a JSON answer; an answer that isn't an object is read as lines, with zero scores and the reason parse_fallback."""
    lines = label_lines(c)

    def good(v: Column) -> Column:
        half = lambda k: F.when(number_of(v, k).isNull(), 0.5).otherwise(unit(number_of(v, k))).alias(k)
        none = F.array().cast("array<string>")
        listed = lambda k, n: first_n(F.filter(F.transform(F.coalesce(texts_of(v, k), none), lambda s: F.substring(strip(s), 1, 200)), lambda s: s != ""), n)
        label = F.upper(text_of(v, "label"))
        return F.struct(
            F.when(label.isin(L.LABELS), label).otherwise("OTHER").alias("label"), half("confidence"), half("audience_fit"), half("pain_intensity"), half("actionability"), listed("evidence_spans", 5).alias("evidence_spans"),
            listed("topic_tags", 5).alias("topic_tags"), F.transform(listed("claim_anchors", 3), lambda s: first_words(s)).alias("claim_anchors"), F.nullif(strip(text_of(v, "exclude_reason")), F.lit("")).alias("exclude_reason"),
        )

    none = F.array().cast("array<string>")
    zero = lambda n: F.lit(0.0).alias(n)
    bad = F.struct(lines["label"].alias("label"), lines["confidence"].alias("confidence"), zero("audience_fit"), zero("pain_intensity"), zero("actionability"), none.alias("evidence_spans"), none.alias("topic_tags"), none.alias("claim_anchors"), F.lit("parse_fallback").alias("exclude_reason"))
    return with_object(unfenced(c), good, bad)


def editor_answer(c: Column) -> Column:
    """struct(featured, secondary, catalysts, rejects) of an editor's answer; null if it is no object, and then ``gate_fallback`` decides.  Rejects that are no objects are left out."""
    kind = "struct<featured: array<string>, secondary: array<string>, catalysts: array<string>, rejects: array<struct<id: string, reason: string>>>"

    def read(v: Column) -> Column:
        ids = lambda k: F.coalesce(texts_of(v, k), F.array().cast("array<string>"))
        each = F.coalesce(F.try_variant_get(v, "$.rejects", "array<variant>"), F.array().cast("array<variant>"))
        objects = F.filter(each, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
        rejects = F.transform(objects, lambda x: F.struct(text_of(x, "id").alias("id"), text_of(x, "reason").alias("reason")))
        return F.struct(ids("featured_pain_ids").alias("featured"), ids("secondary_pain_ids").alias("secondary"), ids("catalyst_ids").alias("catalysts"), rejects.alias("rejects")).cast(kind)

    return with_object(unfenced(c), read, F.lit(None).cast(kind))
