"""Constraints of the tables: what a row must hold to be written, and where the others go."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REJECTS = "table_name string, constraint_name string, row string"


@dataclass(frozen=True)
class Rules:
    """NOT NULL columns, CHECK conditions by name (null passes, as in SQL), a UNIQUE key, and foreign keys as (column, parent table)."""

    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    parents: tuple[tuple[str, str], ...] = ()


def _unit(*columns: str) -> dict[str, str]:
    return {f"{c}_range": f"{c} BETWEEN 0 AND 1" for c in columns}


# The constraints of the engine's tables.
RULES = {
    "interests": Rules(required=("name",)),
    "interest_sources": Rules(required=("interest_id", "source_type", "source_value"), checks={"source_type_known": "source_type IN ('subreddit', 'rss')", "weight_range": "weight BETWEEN 0 AND 2"}, parents=(("interest_id", "interests"),)),
    "raw_items": Rules(required=("source", "source_id", "title")),
    "item_labels": Rules(required=("raw_item_id", "label"), checks={"label_known": "label IN ('PAIN', 'DISCUSSION', 'NEWS', 'OTHER')"} | _unit("confidence", "audience_fit", "pain_intensity", "actionability"), parents=(("raw_item_id", "raw_items"),)),
    "embeddings": Rules(required=("raw_item_id",), parents=(("raw_item_id", "raw_items"),)),
    "clusters": Rules(required=("date", "cluster_index"), unique=("date", "cluster_index")),
    "cluster_items": Rules(required=("cluster_id", "raw_item_id"), unique=("cluster_id", "raw_item_id"), parents=(("cluster_id", "clusters"), ("raw_item_id", "raw_items"))),
    "catalysts": Rules(required=("date",), checks=_unit("confidence")),
    "reports": Rules(required=("date",), unique=("date",)),
}
#: Children of a table: rows that go with a deleted parent.
CHILDREN = {parent: [(name, column) for name, rules in RULES.items() for column, p in rules.parents if p == parent] for parent in RULES}


def checked(name: str, rows: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """rows with ``_broken``: the first constraint that a row breaks, or null.

    ``parents`` has, by column, the ids (one column ``id``, once each) that there are of the row's parents.  Of rows
    with one UNIQUE key the first in the order of their JSON stays.
    """
    rules = RULES[name]
    out = rows
    for column, ids in parents.items():
        out = out.join(ids.select(F.col("id").alias(column), F.lit(True).alias(f"_has_{column}")), column, "left")
    broken = [F.when(F.col(c).isNull(), f"{c}_required") for c in rules.required]
    broken += [F.when(~F.coalesce(F.expr(condition), F.lit(True)), label) for label, condition in rules.checks.items()]
    broken += [F.when(F.col(f"_has_{column}").isNull(), f"{column}_unknown") for column in parents]
    out = out.withColumn("_broken", F.coalesce(*broken) if broken else F.lit(None).cast("string")).select(*rows.columns, "_broken")
    if rules.unique:
        # rows that break another constraint don't take the key from others
        place = F.row_number().over(Window.partitionBy(*rules.unique, F.col("_broken").isNull()).orderBy(F.to_json(F.struct(*rows.columns))))
        out = out.withColumn("_place", place).withColumn("_broken", F.coalesce("_broken", F.when(F.col("_place") > 1, "_".join(rules.unique) + "_unique"))).drop("_place")
    return out


def rejects(name: str, rows: DataFrame) -> DataFrame:
    """The rows with ``_broken`` set, as JSON."""
    bad = rows.where("_broken IS NOT NULL")
    return bad.select(F.lit(name).alias("table_name"), F.col("_broken").alias("constraint_name"), F.to_json(F.struct(*[c for c in rows.columns if c != "_broken"])).alias("row"))
