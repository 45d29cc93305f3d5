"""Data changes on Parquet tables, as DataFrame merges and partition overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str | Callable[[Column, Column], Column]]) -> DataFrame:
    """Insert or update by key in one full outer join.

    rules, per column, for keys on both sides: "new", "old", "coalesce" (the
    new value unless null) or a function of (old, new).  ``new`` has one row a
    key (see last_of).
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.withColumn("_old", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), keys, "full_outer")
    out = [F.col(k) for k in keys]
    for name in (c for c in old.columns if c not in keys):
        x = F.col(f"a.{name}")
        if name not in new.columns:
            out.append(x)
            continue
        y, rule = F.col(f"b.{name}"), rules.get(name, "new")
        both = x if rule == "old" else y if rule == "new" else F.coalesce(y, x) if rule == "coalesce" else rule(x, y)
        out.append(F.when(F.col("a._old").isNull(), y).when(F.col("b._new").isNull(), x).otherwise(both).alias(name))
    return joined.select(*out)


def upsert_within(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str | Callable[[Column, Column], Column]], within: list[str]) -> DataFrame:
    """``upsert`` where both sides say by the columns ``within`` in which group a key is: groups are dealt to tasks once, and old and new rows meet inside them.

    ``within`` may not be among the columns of the result, which are those of ``old`` without them.
    """
    names = [c for c in old.columns if c not in keys and c not in within]
    there = [F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in names]
    rows = old.select(*keys, *within, F.lit(0).alias("_new"), *names).unionByName(new.select(*keys, *within, F.lit(1).alias("_new"), *there))
    by_key = Window.partitionBy(*within, *keys).orderBy("_new")
    out = [F.lead("_new").over(by_key).alias("_next"), *keys]
    for name in names:
        y, rule = F.col(name), rules.get(name, "new")
        if name in new.columns and rule == "new":
            out.append(y)
            continue
        x = F.lag(name).over(by_key)
        both = x if name not in new.columns or rule == "old" else F.coalesce(y, x) if rule == "coalesce" else rule(x, y)
        out.append(F.when(F.lag("_new").over(by_key).isNotNull(), both).otherwise(y).alias(name))
    return rows.repartition(*within).select(*out).where("_next IS NULL").drop("_next")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def update_column(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Sets one column from (key, column) rows; other rows keep theirs."""
    fresh = new.select(key, F.col(column).alias("_new"))
    return old.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).select(old.columns)


def replace_partition(old: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """All rows of one partition value replaced; what a dynamic partition overwrite leaves behind."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def overwrite_partitions(df: DataFrame, path: str, column: str) -> None:
    """Writes df and replaces only the partitions that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One markdown text file, of the column ``markdown``."""
    df.select(F.col("markdown").alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def align(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a declared schema: missing ones are null, or empty for arrays; others are dropped."""
    from pyspark.sql.types import ArrayType, _parse_datatype_string

    out = []
    for f in _parse_datatype_string(ddl).fields:
        missing = F.array().cast(f.dataType) if isinstance(f.dataType, ArrayType) else F.lit(None).cast(f.dataType)
        out.append((F.col(f.name).cast(f.dataType) if f.name in df.columns else missing).alias(f.name))
    return df.select(*out)
