"""Costly values are worked out once, however many fields of theirs are used."""

import pytest
from pyspark.sql import functions as F

from oreline.functions import normalise
from oreline.plans import cards


def uses(df, text: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def evidence(rows):
    return rows.withColumn("found", F.struct(F.array(F.lit("one two")).alias("snippets"), F.array(F.lit("http://a")).alias("links")))


@pytest.mark.parametrize("read", [
    lambda a: normalise.cluster_summary(a, F.lit("t"), F.lit("s"), F.lit("p"), F.lit("w"), F.array(F.lit("http://a"))), normalise.idea_cards, normalise.cards, normalise.catalysts,
    lambda a: normalise.item_answer(a, F.col("found"), F.lit("Med")),
])
def test_an_answer_is_read_once(spark, read):
    rows = evidence(spark.createDataFrame([("{}",)], "a string"))
    assert uses(rows.select(read(F.reverse("a")).alias("x")), "reverse(a#") == 1


def test_an_entry_of_evidence_is_read_once(spark):
    rows = spark.createDataFrame([("{}",)], "a string")
    assert uses(rows.select(normalise.evidence_entry(F.col("a")).alias("x")).select("x"), "from_json") + uses(rows.select(normalise.evidence_entry(F.col("a")).alias("x")), "JsonToStructs") == 1


def test_a_part_of_an_object_is_made_once(spark):
    rows = spark.createDataFrame([("x", None)], "a string, b string")
    made = rows.select(cards._object(one=cards._object(two=cards._js(F.reverse("a"))), three=cards._js(F.col("b")), four=F.col("b")).alias("x"))
    assert uses(made, "reverse(a#") == 1 and made.first().x == '{"one":{"two":"x"},"three":null}'


def test_reports_read_the_texts_once(spark):
    from oreline.plans.catalogue import QUERIES

    from .oracle import SF

    assert QUERIES["daily_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
