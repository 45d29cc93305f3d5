"""The keyed store: pruned scans, few rewritten files, lost races, cleared versions, dead writers."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from oreline.operators import keyed
from oreline.operators.keyed import Conflict, KeyedTable

SCHEMA = "k string, v long, url string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], slots=4, moves=True)


def rows(spark, day, keys, v=1):
    return spark.createDataFrame([(str(k), v, f"u{v}", datetime.date.fromisoformat(day) if day else None) for k in keys], "k string, v long, url string, at date")


def put(table, df, **more):
    table.change(df, {"url": "old"}, F.col("at"), **more)


def content(table):
    return {r.k: (r.day, r.v, r.url) for r in table.read().collect()}


def files(table):
    return {f for f in glob.glob(f"{table.path}/rows/**/*.parquet", recursive=True)}


def test_scan_of_a_day_is_pruned(spark, table):
    for d in ("2024-01-01", "2024-01-02", "2024-01-03"):
        put(table, rows(spark, d, [f"{d}/{i}" for i in range(20)]))
    one = table.read(["2024-01-02"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 20 and "PartitionFilters: [isnotnull(day" in plan and "day=2024-01-01" not in " ".join(one.inputFiles())
    assert all("day=2024-01-02" in f for f in one.inputFiles())
    # by keys: only the partitions that the index names
    two = table.of_keys(spark.createDataFrame([("2024-01-03/5",), ("none",)], "k string"))
    assert [r.k for r in two.collect()] == ["2024-01-03/5"] and len(two.inputFiles()) == 1


def test_change_rewrites_only_what_it_touches(spark, table):
    put(table, rows(spark, "2024-01-01", range(50)))
    put(table, rows(spark, "2024-01-02", range(50, 60)))
    before = files(table)
    put(table, rows(spark, "2024-01-02", [50, 51, 70], 2))
    new = files(table) - before
    assert new and all("day=2024-01-02" in f for f in new)
    got = content(table)
    assert got["50"] == ("2024-01-02", 2, "u1") and got["70"] == ("2024-01-02", 2, "u2") and len(got) == 61 and got["3"] == ("2024-01-01", 1, "u1")
    # a key fetched anew on another day moves: its old and its new partition are rewritten
    before = files(table)
    put(table, rows(spark, "2024-01-03", [7], 3))
    assert {f.split("day=")[1].split("/")[0] for f in files(table) - before} <= {"2024-01-01", "2024-01-03"} and len(files(table) - before) == 2
    assert content(table)["7"] == ("2024-01-03", 3, "u1") and len(content(table)) == 61
    assert table.read(["2024-01-03"]).count() == 1 and [r.v for r in table.of_keys(spark.createDataFrame([("7",)], "k string")).collect()] == [3]
    # without insert, unknown keys are left out and rows stay
    table.change(spark.createDataFrame([("7", 9), ("new", 9)], "k string, v long"), insert=False)
    assert content(table)["7"] == ("2024-01-03", 9, "u1") and "new" not in content(table)


def test_of_two_writers_one_loses(spark, table, monkeypatch):
    put(table, rows(spark, "2024-01-01", range(5)))
    first, commit = [], KeyedTable._commit

    def late(self, *args):
        if not first:
            first.append(1)
            put(table, rows(spark, "2024-01-01", [1], 7))
        commit(self, *args)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    with pytest.raises(Conflict):
        put(table, rows(spark, "2024-01-01", [2], 8))
    assert content(table)["1"][1] == 7 and content(table)["2"][1] == 1
    first.clear()
    table.retried(2, rows(spark, "2024-01-01", [2], 8), {"url": "old"}, F.lit("2024-01-01"))
    assert content(table)["2"][1] == 8 and content(table)["1"][1] == 7
    assert table.folder.names("stage") == []


def test_old_versions_are_cleared(spark, table):
    for v in range(6):
        put(table, rows(spark, "2024-01-01", range(8), v))
    assert len(table.folder.names("versions")) == 2 and content(table)["3"][1] == 5
    # what one more reader of the version before may need is there, no more
    old = table.manifest(table.manifest()["version"] - 1)
    assert {r.v for r in table._open(old, sorted(old["parts"])).collect()} == {4}
    assert len({f.split("write=")[1].split("/")[0] for f in files(table)}) == 2


def test_a_writer_dies(spark, table, monkeypatch):
    put(table, rows(spark, "2024-01-01", range(5)))
    real = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        put(table, rows(spark, "2024-01-01", [1], 7))
    monkeypatch.setattr(KeyedTable, "_commit", real)
    assert content(table)["1"][1] == 1
    # half a manifest: a younger one may be at work, an old one is passed over
    table.folder.create("versions/0000000002.json", "{")
    with pytest.raises(Conflict):
        put(table, rows(spark, "2024-01-01", [1], 8))
    monkeypatch.setattr(keyed, "STALE", -1)
    put(table, rows(spark, "2024-01-01", [1], 8))
    assert content(table)["1"][1] == 8 and table.manifest()["version"] == 3
    assert table.clear_orphans(3600) == [] and len(table.clear_orphans(-1)) == 2 and content(table)["1"][1] == 8


def test_index_is_merged_and_odd_rows(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "COMPACT", 2)
    for i in range(6):
        put(table, rows(spark, f"2024-01-0{i + 1}", [i, "same"], i))
    assert len(table.manifest()["index"]) <= 3 and len(content(table)) == 7 and content(table)["same"] == ("2024-01-06", 5, "u0")
    put(table, rows(spark, None, ["undated"]))
    assert content(table)["undated"][0] == keyed.NO_DAY
    n = table.manifest()["version"]
    put(table, rows(spark, "2024-01-01", []))
    assert table.manifest()["version"] == n + 1 and len(content(table)) == 8
    assert table.of_keys(spark.createDataFrame([], "k string")).count() == 0
    assert os.path.isdir(f"{table.path}/versions")


def test_a_change_deals_its_rows_out_once(spark, table, monkeypatch):
    """The first write moves rows to their partitions only, a later one to where the old ones are; repeated keys are ordered alone."""
    from pyspark.sql import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet

    def told(self, path, *args, **more):
        if "/rows/" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return parquet(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    put(table, rows(spark, "2024-01-01", range(20)))
    put(table, rows(spark, "2024-01-02", range(10, 30), 2))
    # a join would sort both sides by the key; the index meets the new rows only
    assert plans[0].count("Join") == 0 and plans[0].count("Exchange hashpartitioning") == 1 and "FullOuter" not in plans[1]
    got = content(table)
    assert len(got) == 30 and got["5"] == ("2024-01-01", 1, "u1") and got["15"] == ("2024-01-02", 2, "u1") and got["25"] == ("2024-01-02", 2, "u2")
    both = rows(spark, "2024-01-03", [1, 40], 3).unionByName(rows(spark, "2024-01-04", [1, 40, 41], 4))
    put(table, both, last=[F.desc("v")])
    got = content(table)
    assert len(got) == 32 and got["1"] == ("2024-01-04", 4, "u1") and got["40"] == ("2024-01-04", 4, "u4") and got["41"] == ("2024-01-04", 4, "u4")


def test_rules_of_an_upsert_within_groups(spark):
    """As upsert: rules, columns that new rows lack, a function, nulls, keys on one side."""
    from oreline.operators import store

    old = spark.createDataFrame([(1, "a", 1, "x", 5, "p"), (2, "b", None, "y", 6, "q"), (3, "c", 3, None, 7, "r")], "k int, u string, s int, l string, n int, g string")
    new = spark.createDataFrame([(2, "B", 9, "Y", 1, "q"), (3, None, None, "Z", 2, "r"), (4, "D", 4, "W", 3, "p")], "k int, u string, s int, l string, n int, g string").drop("l")
    rules = {"u": "old", "s": "coalesce", "n": lambda x, y: x + y}
    want = store.upsert(old.drop("g"), new.drop("g"), ["k"], rules).collect()
    assert sorted(store.upsert_within(old, new, ["k"], rules, ["g"]).select("k", "u", "s", "l", "n").collect()) == sorted(want) and len(want) == 4
