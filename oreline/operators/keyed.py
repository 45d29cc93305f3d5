"""Parquet tables with a key, a day and versions: scans read the days they need, changes rewrite only what holds their keys.

Rows lie in partitions (day, slot), the slot being a hash of the key; a version
is a manifest that lists the folder of each partition.  A change stages its
rows, asks the key index where their keys are, rewrites those partitions into a
new folder and creates the next manifest.  Creating fails if another writer was
first, so of two writers from the same version one gets ``Conflict`` and can
start again; a writer that dies leaves a folder that no manifest names.  What
the last ``keep`` versions don't name any more is deleted.

The key index is itself Parquet by slot: (key, day) appended by every change
for the keys that are new or moved, the latest entry counting, and merged into
one folder every COMPACT changes.  A change and a look-up by keys read only the
index of their slots.  Lists on the driver are those of partitions, never of
rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from . import store, work

COMPACT = 16
STALE = 600  # seconds after which an unfinished version is that of a dead writer
NO_DAY = "none"


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Folder:
    """File operations below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at(name))) if self.fs.exists(self._at(name)) else []

    def modified(self, name: str) -> float:
        return self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; ``Conflict`` if it is there."""
        try:
            stream = self.fs.create(self._at(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from None
            raise
        stream.write(bytearray(text.encode()))
        stream.close()


class KeyedTable:
    """``schema`` has the columns ``keys``, which are never null.  With ``moves`` a changed row goes to its new day, else it stays where it is."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], slots: int = 16, moves: bool = False, keep: int = 2):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.slots, self.moves, self.keep = slots, moves, keep
        self.folder = Folder(spark, self.path)

    # ---- versions

    def manifest(self, version: int | None = None) -> dict:
        """The last finished version, or one of those kept."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("versions")] if version is None else [version]
        for n in sorted(numbers, reverse=True):
            try:
                return json.loads(self.folder.read(f"versions/{n:010}.json"))
            except ValueError:  # its writer died
                continue
        return {"version": 0, "parts": {}, "index": [], "gone": []}

    def _readable(self) -> dict[int, dict]:
        """The finished versions by number."""
        out = {}
        for name in self.folder.names("versions"):
            try:
                out[int(name.removesuffix(".json"))] = json.loads(self.folder.read(f"versions/{name}"))
            except ValueError:
                continue
        return out

    def _commit(self, old: dict, parts: dict[str, str], index: list[str], gone: list[str]) -> None:
        number, finished = old["version"] + 1, self._readable()
        for name in self.folder.names("versions"):
            n = int(name.removesuffix(".json"))
            if n >= number and n not in finished:
                if self.folder.modified(f"versions/{name}") > time.time() - STALE:
                    raise Conflict(name)  # somebody may be at it
                number = n + 1
        self.folder.create(f"versions/{number:010}.json", json.dumps({"version": number, "parts": parts, "index": index, "gone": gone}))
        self._clear()

    def _clear(self) -> None:
        """Deletes what only versions older than the last ``keep`` name: those versions, and what the oldest that stays has replaced."""
        finished = sorted(self._readable().items())
        for number, m in finished[: len(finished) - self.keep + 1]:
            for folder in m["gone"]:
                self.folder.delete(folder)
            if number < finished[-self.keep][0]:
                self.folder.delete(f"versions/{number:010}.json")

    def clear_orphans(self, older_than: float = 86_400) -> list[str]:
        """Deletes folders that no version names, as dead writers leave them, once they are old enough."""
        named = {f.split("/")[1] for m in self._readable().values() for f in [*m["parts"].values(), *m["index"], *m["gone"]]}
        found = [f"{kind}/{n}" for kind in ("rows", "index", "stage") for n in self.folder.names(kind) if n not in named and self.folder.modified(f"{kind}/{n}") < time.time() - older_than]
        for name in found:
            self.folder.delete(name)
        return found

    # ---- reading

    def _none(self, schema: str) -> DataFrame:
        """No rows, which the optimiser knows: nothing is shuffled to be joined with them."""
        fields = _parse_datatype_string(schema).fields
        return self.spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")

    def _open(self, manifest: dict, parts: list[str]) -> DataFrame:
        """Rows of partitions, with day and slot, which a filter prunes."""
        schema = f"{self.schema}, write string, day string, slot int"
        if not parts:
            return self._none(schema).drop("write")
        paths = [f"{self.path}/{manifest['parts'][p]}" for p in parts]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths).drop("write")

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The table with the column ``day``, of some days or all."""
        m = self.manifest()
        rows = self._open(m, [p for p in sorted(m["parts"]) if days is None or p.split("/")[0] in days])
        return (rows if days is None else rows.where(F.col("day").isin(days))).drop("slot")

    def _index(self, manifest: dict, slots: list[int]) -> DataFrame:
        """(keys, day): where keys of the slots are."""
        types = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(self.schema).fields}
        fields = [f"{k} {types[k]}" for k in self.keys]
        schema = ", ".join([*fields, "version long", "day string", "write string", "slot int"])
        if not manifest["index"]:
            return self._none(schema).select(*self.keys, "day")
        paths = [f"{self.path}/{f}" for f in manifest["index"]]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/index").parquet(*paths).where(F.col("slot").isin(slots))
        return rows.groupBy(*self.keys).agg(F.max(F.struct("version", "day")).alias("m")).select(*self.keys, F.col("m.day").alias("day"))

    def of_keys(self, wanted: DataFrame) -> DataFrame:
        """Rows with the keys, read from the partitions that the index names."""
        m, own = self.manifest(), wanted.select(*self.keys).dropDuplicates()
        slots = [r[0] for r in own.select(self._slot().alias("slot")).distinct().collect()]
        places = self._index(m, slots).where("day IS NOT NULL").join(own, self.keys, "left_semi").select("day", self._slot().alias("slot")).distinct().collect()
        return self._open(m, sorted({f"{r['day']}/{r['slot']}" for r in places})).join(own, self.keys, "left_semi").drop("slot", "day")

    def known(self, wanted: DataFrame) -> DataFrame:
        """The keys, once each, that the table has; the index alone is read."""
        own = wanted.select(*self.keys).dropDuplicates()
        slots = [r[0] for r in own.select(self._slot().alias("slot")).distinct().collect()]
        return own.join(self._index(self.manifest(), slots).where("day IS NOT NULL"), self.keys, "left_semi")

    # ---- changing

    def remove(self, wanted: DataFrame) -> None:
        """Deletes the rows of the keys."""
        self.retried(3, wanted.select(*self.keys).dropDuplicates(), insert=False, delete=True)

    def change(self, rows: DataFrame, rules: dict[str, str | Callable[[Column, Column], Column]] | None = None, day: Column | None = None, insert: bool = True, delete: bool = False, last: list[Column] | None = None) -> None:
        """Inserts or updates by key under the rules of ``store.upsert``; without ``insert`` rows of unknown keys are left out, with ``delete`` those of the keys go.

        ``rows`` have one row a key, or an order ``last`` of which the first row of a key counts, and may lack columns; ``day`` says where new rows
        go.  The index then has no day for a deleted key.  Old and new rows meet in the partition where the old ones are.
        """
        base, own = self.manifest(), f"write={uuid.uuid4().hex}"
        try:
            day = F.coalesce(day.cast("string"), F.lit(NO_DAY)) if day is not None else F.lit(NO_DAY)
            rows.withColumns({"_day": day, "slot": self._slot()}).write.parquet(f"{self.path}/stage/{own}")
            new = self.spark.read.parquet(f"{self.path}/stage/{own}")
            new = self._once(new, last) if last else new
            slots = [r[0] for r in new.select("slot").distinct().collect()]
            there = self._index(base, slots).where("day IS NOT NULL").withColumnRenamed("day", "_was")
            placed = new.join(there, self.keys, "left" if insert else "inner")
            goes = F.col("_day") if self.moves and insert else F.coalesce("_was", "_day")
            placed = placed.withColumn("day", goes)
            hit = placed.select(F.explode(F.array_distinct(F.array(F.coalesce("_was", "day"), "day"))).alias("d"), "slot").distinct().collect()
            parts = sorted({f"{r['d']}/{r['slot']}" for r in hit} & base["parts"].keys())
            old = self._open(base, parts)
            if delete or not parts:
                both = old.join(placed, self.keys, "left_anti") if delete else store.upsert(old, placed.drop("_day", "_was"), self.keys, rules or {})
                both = both.repartition("day", "slot")
            else:
                group = {"_in_day": F.coalesce("_was", "day"), "_in_slot": F.col("slot")}
                both = store.upsert_within(old.withColumns({"_in_day": F.col("day"), "_in_slot": F.col("slot")}), placed.withColumns(group).drop("_day", "_was"), self.keys, rules or {}, [*group])
            both.write.partitionBy("day", "slot").parquet(f"{self.path}/rows/{own}")
            now = F.lit(None).cast("string") if delete else F.col("day")
            moved = placed.where(F.col("_was").isNull() | now.isNull() | (F.col("_was") != now)).select(*self.keys, F.lit(base["version"] + 1).cast("long").alias("version"), now.alias("day"), "slot")
            index, gone = [*base["index"], f"index/{own}"], [base["parts"][p] for p in parts]
            if len(index) > COMPACT:
                everywhere = self._index(base, list(range(self.slots))).where("day IS NOT NULL").select(*self.keys, F.lit(base["version"]).cast("long").alias("version"), "day", self._slot().alias("slot"))
                moved, gone, index = moved.unionByName(everywhere), gone + base["index"], [f"index/{own}"]
            moved.repartition("slot").write.partitionBy("slot").parquet(f"{self.path}/index/{own}")
            made = {f"{d.removeprefix('day=')}/{s.removeprefix('slot=')}": f"rows/{own}/{d}/{s}" for d in self.folder.names(f"rows/{own}") if d.startswith("day=") for s in self.folder.names(f"rows/{own}/{d}")}
            self._commit(base, {p: f for p, f in base["parts"].items() if p not in parts} | made, index, gone)
        except Exception:
            self.folder.delete(f"rows/{own}")
            self.folder.delete(f"index/{own}")
            raise
        finally:
            self.folder.delete(f"stage/{own}")

    def _once(self, staged: DataFrame, last: list[Column]) -> DataFrame:
        """One row a key: only rows of repeated keys are ordered, the others stay where they lie."""
        repeated = work.kept(staged.groupBy(*self.keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
        if repeated.limit(1).count() == 0:
            return staged
        chosen = work.kept(store.last_of(staged.join(repeated, self.keys, "left_semi"), self.keys, last))
        return staged.join(repeated, self.keys, "left_anti").unionByName(chosen)

    def retried(self, attempts: int, *args, **kwargs) -> None:
        """``change``, begun again where another writer was first."""
        for k in range(attempts):
            try:
                self.change(*args, **kwargs)
                return
            except Conflict:
                if k + 1 == attempts:
                    raise
