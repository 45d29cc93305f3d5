"""Conversation repair against its SQL and against all edits of short conversations."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from oreline.llm import repair
from tests.oracle import SF, assert_same, tables

TURNS = "conv_id long, turn long, role string, text string, copies int, hi string, fault int"


def test_matches_sql(spark):
    assert_same(repair.op12_repair(spark, SF).toPandas(), tables(), repair.SQL)


def all_edits(codes, roles):
    """The cheapest (cost, audit) by trying every edit, with at most two inserts in a row."""
    best = []
    for gaps in itertools.product(("", "I", "II"), repeat=len(codes) + 1):
        for edits in itertools.product("KRD", repeat=len(codes)):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            if any(e != "D" and c == "D" for e, c in zip(edits, codes, strict=True)):
                continue
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) + sum(5 for e, c in zip(edits, codes, strict=True) if e != "D" and c.isupper())
            kept, left = "", iter(roles)
            for e in audit:
                r = next(left) if e != "I" else None
                kept += r if e == "K" else "?" if e in "RI" else ""
            shape = ["s" + "ua" * len(kept), "ua" * len(kept)]
            if any(len(kept) == 0 or (len(kept) - (f[0] == "s")) % 2 == 0 and len(kept) > 1 and all(x in (y, "?" if y != "s" else y) for x, y in zip(kept, f)) for f in shape):  # noqa: B905
                best.append((cost, audit))
    return min(best)


def test_search_matches_all_edits():
    r = random.Random(3)
    cases = ["", "s", "u", "a", "x", "D", "U", "su", "ua", "au", "sua", "ss", "uu", "uA", "sUA"] + ["".join(r.choice("suaxDSUA") for _ in range(r.randint(1, 4))) for _ in range(60)]
    for codes in cases:
        ((cost, _, audit, _, _),) = repair.search(codes)
        assert (cost, audit) == all_edits(codes, codes.lower()), codes


def test_blocks_change_nothing(monkeypatch):
    r = random.Random(5)
    for _ in range(200):
        codes = "".join(r.choice("suaxDUA") for _ in range(r.randint(0, 40)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}[c.lower()], f"t{k}", "blank" if c == "D" else "truncated" if c.isupper() else "") for k, c in enumerate(codes)]
        out = []
        for size in (3, 7, 512):
            monkeypatch.setattr(repair, "BLOCK_TURNS", size)
            conv = repair._Conversation(1)
            for k, row in enumerate(rows):
                conv.add(k, *row)
            out.append(conv.row())
        assert out[0] == out[1] == out[2]


def test_odd_rows(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [
        (1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes! \n", 1),  # fine
        (2, None, None, None, 1), (2, 5, "", "a.", 1), (2, 9, "user", "b.", 2),  # nulls, an empty role, a repeat and gaps
        (3, 0, "user", "gone.", 0),  # nothing left
        (None, 0, "system", "S.", 1), (None, 1, "user", "Q?", 1), (None, 1, "user", "Q?", 1),  # no id, one turn twice
        (4, 0, "user", " \t\x0b\n", 1), (4, 1, "assistant", "end" + " " * 50_000, 1),
    ]
    spread = spark.createDataFrame([(*r, "h", 1) for r in rows], TURNS).withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    got = {r.conv_id: r for r in repair.repair(spread).collect()}
    pick = lambda r: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit)
    assert pick(got[1]) == (0, 0, 0, 0, 0, 0, "KK") and got[1].repaired_sha256 == sha("user:Hi.\nassistant:Yes! \n")
    assert pick(got[2]) == (3, 1, 1, 0, 3, 6, "DRRD") and got[2].repaired_sha256 == sha("user:a.\nassistant:b.")
    assert pick(got[3]) == (0, 0, 0, 0, 0, 0, "") and got[3].repaired_sha256 == sha("")
    assert pick(got[None]) == (0, 0, 1, 0, 1, 4, "RRD") and pick(got[4]) == (0, 1, 0, 1, 0, 4, "DD")
    assert repair.repair(spread.limit(0)).count() == 0 and repair.repair(repair.damage(spread.withColumn("copies", F.lit("x")))).count() == 5


def test_long_conversation(spark, monkeypatch):
    """One conversation of many turns in blocks: the same as in one block, and well formed."""
    r = random.Random(7)
    rows = [(1, k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", f"c{k}?", ""]), 1, "", 0) for k in range(2500)]
    turns = spark.createDataFrame(rows, TURNS)
    (row,) = repair.repair(turns).collect()
    codes, seen = [], set()
    for _, _, role, text, *_ in rows:
        must = not text or (role, text) in seen
        seen.add((role, text))
        c = role[0] if role[0] in "sua" else "x"
        codes.append("D" if must else c if re.search("[.?]", text) else c.upper())
    ((cost, _, audit, _, _),) = repair.search("".join(codes))
    assert (row.cost, row.audit) == (cost, audit) and row.gaps == 0
    kept = "".join(role[0] for role, _ in repair.repaired(audit, 0, [(x[2], x[3]) for x in rows]))
    assert re.fullmatch("(s?(ua)+)?", kept) and len(kept) > 100
