"""Conversation structure repair: the cheapest edits that make a conversation well formed.

Method.  A conversation's edits are paths through a lattice of (turn index,
grammar state) that is never built: Dijkstra's search makes the edges of a node
when it pops it.  The queue's key is (cost, audit), the audit being the initials
of the edits so far; the search ends with the first accepting end node that is
popped, which is the cheapest path and of those the ASCII-least.  Edits: Keep
costs 0, Rerole 1, Delete 2, Insert 5; a truncated turn that stays adds 5, a
blank or repeated one has to go.  Roles must read ``(s?(ua)+)?``.

A long conversation is searched in blocks.  A block but the last goes on until
every state at its end is popped, without inserts at the end, which the next
block makes.  So no audit there begins another one, and from then on (cost, rank
of the audit at the block's start, audit since) orders as (cost, audit) does.

Spark brings the rows of a conversation together and in order by one exchange
and its external sort; repeated turns are found by a window over hashes of role
and text in the same partitioning.  A task streams over its rows and holds a
block of turns, its audits, and four states of the digest, whatever the length
of a conversation.  The digest of one conversation is by its nature one
sequence of steps, so a conversation is read by one task.

Defined cases.  A null role or text is one space, in the hashed key too a null
id or turn.  Rows without an id are one conversation.  Null turns come first;
rows of one turn by role, then text.  An empty role is none of s, u, a.  A
conversation without rows after damage has zeros, an empty audit and the digest
of the empty string.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kind_of

BLOCK_TURNS, BLOCK_CHARS = 512, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after system, after user, after assistant; where each role initial leads, and what edits may add.
_LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ADDED = ("user", "user", "assistant", "user")
_ACCEPTING = (0, 3)
_LEGAL = {"su", "ua", "au"}
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@functools.lru_cache(maxsize=1 << 16)
def search(codes: str, starts: tuple[tuple[int, int, int], ...] = ((0, 0, 0),), last: bool = True) -> tuple[tuple[int, int, str, int, int], ...]:
    """Best paths (cost, rank of the start, audit, start state, end state) over turns given by codes, cheapest first.

    A code is the role's initial (x: another one), in upper case if the turn is truncated, or D if it has to go.
    ``starts`` are (cost, rank, state).  Of the last block only the first accepting path is returned.
    """
    heap = [(cost, rank, "", 0, state, state) for cost, rank, state in starts]
    heapq.heapify(heap)
    done, ends = set(), []
    while heap:
        cost, rank, audit, i, state, origin = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            if not last or state in _ACCEPTING:
                ends.append((cost, rank, audit, origin, state))
                if last:
                    break
            if not last:
                continue
        added = _LEADS[state][_ADDED[state][0]]
        heapq.heappush(heap, (cost + INSERT, rank, audit + "I", i, added, origin))
        if i == len(codes):
            continue
        code = codes[i]
        heapq.heappush(heap, (cost + DELETE, rank, audit + "D", i + 1, state, origin))
        if code != "D":
            stays = cost + (TRUNCATED if code.isupper() else 0)
            heapq.heappush(heap, (stays + REROLE, rank, audit + "R", i + 1, added, origin))
            if code.lower() in _LEADS[state]:
                heapq.heappush(heap, (stays + KEEP, rank, audit + "K", i + 1, _LEADS[state][code.lower()], origin))
    return tuple(ends)


def repaired(audit: str, state: int, turns: list[tuple[str, str]]):
    """(role, text) of the turns that the edits leave."""
    left = iter(turns)
    for edit in audit:
        role, text = (_ADDED[state], "") if edit == "I" else next(left)
        if edit != "D":
            role = _ADDED[state] if edit == "R" else role
            yield role, text
            state = _LEADS[state][role[0]]


class _Conversation:
    """What is kept of one conversation while its turns go by."""

    def __init__(self, conv_id):
        self.conv_id, self.count = conv_id, dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.initial = None
        self.n_turns = self.chars = 0
        self.codes: list[str] = []
        self.turns: list[tuple[str, str]] = []
        # by state: cost, rank, the audit in parts, digest so far, whether a line came before
        self.paths = {0: (0, 0, [], hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.n_turns == 0 else self.first_turn
            self.last_turn, self.n_turns = turn, self.n_turns + 1
        initial = role[:1]
        if self.initial is not None:
            self.count["illegal"] += self.initial + initial not in _LEGAL
        self.initial = initial
        if fault:
            self.count[fault] += 1
        code = initial if initial and initial in "sua" else "x"
        self.codes.append("D" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        self.turns.append((role, text))
        self.chars += len(text)
        if len(self.codes) >= BLOCK_TURNS or self.chars >= BLOCK_CHARS:
            self._advance(False)

    def _advance(self, last: bool) -> None:
        starts = tuple(sorted((cost, rank, state) for state, (cost, rank, *_) in self.paths.items()))
        found = search("".join(self.codes), starts, last)
        # no audit begins another one, so their order is that of the ranks and then of what followed
        order = {end: k for k, end in enumerate(sorted(found, key=lambda x: (x[1], x[2])))}
        paths = {}
        for end in found:
            cost, _, audit, origin, state = end
            parts, digest, begun = self.paths[origin][2:]
            digest = digest.copy()
            for role, text in repaired(audit, origin, self.turns):
                digest.update(f"{chr(10) * begun}{role}:{text}".encode("utf-8", "replace"))
                begun = True
            paths[state] = (cost, order[end], [*parts, audit], digest, begun)
        self.paths, self.codes, self.turns, self.chars = paths, [], [], 0

    def row(self) -> tuple:
        self._advance(True)
        ((cost, _, parts, digest, _),) = self.paths.values()
        if self.n_turns:
            self.count["gaps"] = self.last_turn - self.first_turn + 1 - self.n_turns
        self.count["cost"] = cost
        return (self.conv_id, *(self.count[c] for c in _COUNTS), "".join(parts), digest.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each turn as it is after damage, and how often it is there (0: dropped)."""
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return given.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _fault(seen: Column) -> Column:
    """The first fault of a turn; empty if it has none."""
    end = F.rtrim("text", F.lit(_BLANKS))
    return F.when(end == "", "blank").when(seen, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the turns of ``damage``, or any with a number of copies."""
    together = turns.select("conv_id", "turn", "role", "text", "copies", F.xxhash64("role", "text").alias("hi"), F.hash("role", "text").alias("lo")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "hi", "lo").orderBy((F.col("copies") == 0).asc(), F.col("turn").asc_nulls_first())
    faulty = together.withColumn("fault", _fault(F.row_number().over(same) > 1)).drop("hi", "lo")
    ordered = faulty.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = kind_of(turns, "conv_id")
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches):
        current = None

        def finished(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        names, types = ["conv_id", *_COUNTS, "audit", "repaired_sha256"], []
        for batch in batches:
            types, rows = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()], []
            for conv_id, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        rows.append(current.row())
                    current = _Conversation(conv_id)
                for k in range(copies):
                    current.add(turn, role, text, "duplicate" if k and fault != "blank" else fault)
            if rows:
                yield finished(rows)
        if current is not None:
            yield finished([current.row()])

    return ordered.mapInArrow(run, schema)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The unsigned CRC-32 of a text of ASCII characters, with ``crc_table`` joined.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda k: ascii(({text})[k])::BIGINT)), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
), once AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen FROM placed
), rows_ AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM once
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS size
  FROM rows_ GROUP BY conv_id
), inserts(a, b, extra, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
edits(a, b, role, letter, price) AS (VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0), (3, 2, 'u', 'K', 0), (0, 2, NULL, 'R', 1), (1, 2, NULL, 'R', 1), (2, 3, NULL, 'R', 1), (3, 2, NULL, 'R', 1),
  (0, 0, NULL, 'D', 2), (1, 1, NULL, 'D', 2), (2, 2, NULL, 'D', 2), (3, 3, NULL, 'D', 2)),
paths AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counted
  UNION ALL
  SELECT p.conv_id, p.n + 1, e.b, min({{'cost': p.best.cost + i.extra + e.price + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END, 'audit': p.best.audit || i.letters || e.letter}})
  FROM paths p JOIN inserts i ON i.a = p.state JOIN edits e ON e.a = i.b JOIN rows_ r ON r.conv_id = p.conv_id AND r.n = p.n + 1
  WHERE (e.role IS NULL OR e.role = r.role[1]) AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, p.n, e.b
), ends AS (
  SELECT p.conv_id, min({{'cost': p.best.cost + i.extra, 'audit': p.best.audit || i.letters}}) AS best
  FROM paths p JOIN counted c ON c.conv_id = p.conv_id AND c.size = p.n JOIN inserts i ON i.a = p.state WHERE i.b IN (0, 3) GROUP BY p.conv_id
), steps AS (
  SELECT conv_id, k, best.audit[k] AS letter, k - length(replace(best.audit[1:k], 'I', '')) AS inserted FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS k FROM ends)
), left_ AS (
  SELECT s.conv_id, s.k, s.letter, r.role, CASE WHEN s.letter = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.k) AS place
  FROM steps s LEFT JOIN rows_ r ON r.conv_id = s.conv_id AND r.n = s.k - s.inserted AND s.letter <> 'I' WHERE s.letter <> 'D'
), lines AS (
  SELECT l.conv_id, string_agg(CASE WHEN l.letter = 'K' THEN l.role WHEN (l.place - coalesce(f.system, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || l.text, chr(10) ORDER BY l.k) AS whole
  FROM left_ l LEFT JOIN (SELECT conv_id, 1 AS system FROM left_ WHERE place = 1 AND letter = 'K' AND role[1] = 's') f USING (conv_id) GROUP BY l.conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN ends e USING (conv_id) LEFT JOIN lines USING (conv_id)
"""
