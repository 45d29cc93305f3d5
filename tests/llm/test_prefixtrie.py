"""The prefix trie against its SQL, and against plain Python where borders, long conversations and odd rows meet."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from oreline.llm import prefixtrie
from tests.oracle import SF, assert_same, tables

TURNS = "conv_id long, turn long, role string, text string, key string, hundred int, n int"


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(ts, key=lambda x: x[:3])] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {}
    for v in members:
        if v:
            kids.setdefault(v[:-1], []).append(v)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        below = kids.get(v, [])
        leaves[v] = sum(leaves[x] for x in below) or 1
        saved[v] = sum(saved[x] for x in below) + (len(members[v]) - 1) * (len(v[-1][1]) if v else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids.get(v, [])), leaves[v], saved[v], sha(ends.get(v, []))) for v, m in members.items())


def got(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], TURNS)
    names = [f.split()[0] for f in prefixtrie._NODE.split(", ")]
    return sorted(tuple(r) for r in prefixtrie.prefix_trie(df).select(names).collect())


def test_matches_sql(spark):
    assert_same(prefixtrie.op13_trie(spark, SF).toPandas(), tables(), prefixtrie.SQL)


def test_hot_turns_and_many_ranges(spark, monkeypatch):
    """A common first turn, a conversation that most ids repeat, one of many turns and its beginnings; more ranges than conversations in one case."""
    r = random.Random(2)
    rows = []
    for c in range(400, 900):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "Hello" if t == 0 else r.choice("abc") * (t + 1)))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(7)]
    rows += [(2000 + k, t, "user", f"long {t}") for k in range(6) for t in range(600 - k)]
    want = expected(rows)
    for size in (1 << 20, 500):
        monkeypatch.setattr(prefixtrie, "RANGE_BYTES", size)
        assert got(spark, rows) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 3, "user", ""), (1, 3, "user", ""), (1, 0, "a", "bc"), (2, 0, "ab", "c"), (-5, 0, "user", "minus"), (0, 0, "user", "base"), (0, 1, "assistant", "second"), (0, 2, "u", "é😀"), (3, 0, "u", "w" * 200_000)]
    rows += [(c, 0, "user", "short") for c in (501, 502, 503, 504, 505, 506)]  # without a base, so some have no turn left
    want = expected(rows)
    assert got(spark, rows) == want and any(w[1] == 0 and w[7] != prefixtrie.NOBODY for w in want)
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []
    assert got(spark, [(700, 0, "user", "x")] * 3) == expected([(700, 0, "user", "x")] * 3)


def test_loser_tree():
    """Merged runs are in order with the right common prefixes, whatever the number of runs."""
    r = random.Random(4)
    for k in (1, 2, 3, 7, 16):
        keys = {b"".join(bytes([r.randrange(3)]) * prefixtrie.NAME for _ in range(r.randint(0, 6))) for _ in range(200)}
        runs = [[] for _ in range(k)]
        for x in sorted(keys):
            run = r.choice(runs)
            run.append((prefixtrie.common_turns(run[-1][1], x) if run else 0, x))
        out = list(prefixtrie.merged_runs([x for x in runs if x]))
        order = sorted(keys)
        shared = [0, *(next((i for i in range(99) if a[i * prefixtrie.NAME : (i + 1) * prefixtrie.NAME] != b[i * prefixtrie.NAME : (i + 1) * prefixtrie.NAME] or (i + 1) * prefixtrie.NAME > min(len(a), len(b))), 0) for a, b in zip(order, order[1:], strict=False))]
        runs_seen = [x[0] for x in out]
        assert runs_seen == shared and len(out) == len(keys)


def test_open_path_in_parts():
    """A trie walked whole, and cut in two ranges at any entry: inner nodes are finished, those on the border add up."""
    turn = lambda x: hashlib.sha256(x.encode()).digest()[:16] + (3).to_bytes(4, "big")
    keys = sorted(b"".join(map(turn, t)) for t in ["a", "ax", "axy", "axyz", "axw", "b", "bx", "bxy", "c"])
    entries = [[prefixtrie.common_turns(a, b), b, k, 1, "e"] for k, (a, b) in enumerate(zip([b"", *keys], keys, strict=False))]
    whole = {(r[1], r[0]): r for r in prefixtrie.trie_nodes(entries)}
    for cut in range(1, len(entries)):
        n = entries[cut][0]
        parts = [*prefixtrie.trie_nodes(entries[:cut], 0, -1, n), *prefixtrie.trie_nodes([[0, *entries[cut][1:]], *entries[cut + 1 :]], 1, n, -1)]
        inner, borders = [r for r in parts if r[9] is None], {}
        for r in parts:
            if r[9] is not None:
                borders.setdefault((r[1], r[12]), []).append(r)
        assert len(borders) == n + 1 and len(inner) + len(borders) == len(whole)
        assert all(r[3:8] == whole[(r[1], r[0])][3:8] for r in inner)
        for (depth, _), rows in borders.items():
            assert whole[(depth, min(r[0] for r in rows))][3] == sum(r[3] for r in rows)
