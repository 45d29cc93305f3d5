"""A day's intake: every source by itself, so that one that fails leaves the others in."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .tables import Tables

log = logging.getLogger(__name__)


def take_in(tables: Tables, day, sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Puts the items of each source under the day, and returns (name, items, error): what was put, or why nothing was.

    A source is a function that gives mapped items; it is run and stored before the next one.
    """
    told = []
    for name, make in sources.items():
        try:
            rows = work.kept(make().withColumn("fetched_at", F.lit(day).cast("timestamp")))
            tables.put_items(rows)
            told.append((name, rows.count(), None))
        except Exception as e:
            log.warning("source %s failed", name, exc_info=True)
            told.append((name, 0, str(e).split("\n")[0][:500]))
    return tables.spark.createDataFrame(told, "name string, items long, error string")
