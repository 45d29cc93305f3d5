"""Drafts rewritten by a model in a bounded number of rounds, each of which asks only for what is still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise, prompts, render, validate
from ..sources.ledger import Ledger
from ..sources.provider import ModelProvider
from . import work


def rewrite_items(rows: DataFrame, ledger: Ledger, provider: Callable[[], ModelProvider]) -> DataFrame:
    """rows (kind, draft, found, grade, ...) with ``item`` and ``made_by``: first, repaired, second or template.

    The first answer counts if it is a valid item.  One that is an item but breaks rules is sent back with its errors
    once; what is then still open, or could not be read, is asked for a second time, and what fails again is made of
    the draft.  Rows that are done take no part in later rounds, so nobody asks for them.
    """
    grade = F.when(F.col("grade").isin("Low", "Med", "High"), F.col("grade")).otherwise("Med")
    # the task is made of the draft wherever it is asked, so no rows carry it; rows that are done stay out of later rounds
    task = prompts.rewrite(F.col("kind"), F.col("draft"), F.col("found"), grade)
    made = [*rows.columns, "item", "made_by"]
    first = work.kept(_round(rows, task, "first", ledger, provider, salt="0"))
    again = F.when(F.col("_read"), prompts.repair_item(task, F.col("_answer"), F.col("_errors")))
    repaired = work.kept(_round(first.where("item IS NULL"), again, "repaired", ledger, provider, salt="repair").select(*made))
    second = _round(repaired.where("item IS NULL").drop("item", "made_by"), task, "second", ledger, provider, salt="1")
    plain = render.plain_item(F.col("draft"), F.col("found"), F.col("grade"))
    last = second.withColumns({"item": F.coalesce("item", plain), "made_by": F.coalesce("made_by", F.lit("template"))})
    return first.where("item IS NOT NULL").select(*made).unionByName(repaired.where("item IS NOT NULL")).unionByName(last.select(*made))


_ITEM = "struct<hook: string, explanation: string, why_bullets: array<string>, who: string, wedge: string, evidence_snippets: array<string>, links: array<string>, strength_or_impact: string>"


def _round(rows: DataFrame, prompt, name: str, ledger: Ledger, provider, salt: str) -> DataFrame:
    """Asks for rows without an item; sets item and made_by where the answer is valid; _answer, _errors and whether it could be read, _read, tell of the others."""
    asked = ledger.generate(rows.drop("item", "made_by"), prompt, "_answer", provider, salt=salt)
    said = asked.withColumn("_said", normalise.item_answer(F.col("_answer"), F.col("found"), F.col("grade")))
    told = said.withColumn("_errors", F.when(F.col("_said").isNotNull(), validate.item_errors(F.col("_said"))))
    good = F.coalesce(F.size("_errors") == 0, F.lit(False))
    return told.withColumns({"item": F.when(good, F.col("_said").cast(_ITEM)), "made_by": F.when(good, F.lit(name)), "_read": F.col("_said").isNotNull()}).drop("_said")
