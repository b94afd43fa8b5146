"""Conversation repair: cheapest edits by Hirschberg's divide and conquer over a four-state automaton.

A repaired conversation's role initials read ``(s?(ua)+)?``. States: 0 nothing yet, 1 after a system row,
2 after a user row, 3 after an assistant row; 0 and 3 accept. Edits: Keep 0, Rerole 3, Delete 4, Insert 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages

NEVER = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state, role initial: next state
NEW_ROLE = ("user", "user", "assistant", "user")  # role that an inserted or reroled row gets in a state
INSERTED = ({0: "", 2: "I", 3: "II"}, {1: "", 2: "I", 3: "II"}, {2: "", 3: "I"}, {3: "", 2: "I"})  # state, state reached by inserts alone: audit
TAIL = ("", "II", "I", "")  # inserts that end a conversation
END = tuple(INSERT * len(t) for t in TAIL)  # their cost
SPACE = " \t\n\x0b\f\r"


@lru_cache(maxsize=None)
def row_steps(kind: str, start: int) -> tuple[tuple[str, int, int], ...]:
    """(audit, cost, state) of every way to pass one row: inserts before it, then its edit; ASCII order.

    ``kind`` is the row's role initial (s, u, a, other: x), in upper case if it has to go, followed by
    ``t`` if it is truncated. A way ends with the row's own edit, so that no way is another's prefix.
    """
    out = []
    for state, audit in INSERTED[start].items():
        cost, role, extra = INSERT * len(audit), kind[0], TRUNCATED * kind.endswith("t")
        out.append((audit + "D", cost + DELETE, state))
        if role.islower():
            if role in AFTER[state]:
                out.append((audit + "K", cost + KEEP + extra, AFTER[state][role]))
            out.append((audit + "R", cost + REROLE + extra, AFTER[state][NEW_ROLE[state][0]]))
    return tuple(sorted(out))


KINDS = [r + t for r in ("s", "u", "a", "x") for t in ("", "t")] + ["S", "U", "A", "X"]
LETTER = dict(zip(KINDS, "sSuUaAxX1234", strict=True))  # one character a row
STEPS = {LETTER[k]: tuple(row_steps(k, q) for q in range(4)) for k in KINDS}
CHEAPEST = {c: tuple(tuple(min((w for _, w, to in STEPS[c][p] if to == q), default=NEVER) for q in range(4)) for p in range(4)) for c in STEPS}


def forward(kinds: str, costs: list[int]) -> list[int]:
    """Least cost of every state after the rows, from the costs before them."""
    a, b, c, d = costs
    for k in kinds:
        m0, m1, m2, m3 = CHEAPEST[k]
        a, b, c, d = (min(a + w, b + x, c + y, d + z) for w, x, y, z in zip(m0, m1, m2, m3, strict=True))
    return [a, b, c, d]


def backward(kinds: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost to the end of every state before the rows, from the costs behind them."""
    for k in reversed(kinds):
        a, b, c, d = costs
        costs = tuple(min(w + a, x + b, y + c, z + d) for w, x, y, z in CHEAPEST[k])
    return costs


def hirschberg(kinds: str, start: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """(audit, last state) of the ASCII-least of the cheapest ways from ``start`` over the rows; ``ends``: cost to come of each state.

    Forward and backward cost vectors meet in the middle. If several crossings are cheapest, the half
    before the middle is solved over exactly these: its ways are no prefixes of each other, so the least of
    them decides alone. The half behind follows from the state chosen. Space is linear, time n log n.
    """
    if len(kinds) == 1:
        return min((ends[q] + cost, audit, q) for audit, cost, q in STEPS[kinds][start])[1:]
    middle = len(kinds) // 2
    before = forward(kinds[:middle], [0 if q == start else NEVER for q in range(4)])
    behind = backward(kinds[middle:], ends)
    least = min(a + b for a, b in zip(before, behind, strict=True))
    crossings = tuple(b if a + b == least else NEVER for a, b in zip(before, behind, strict=True))
    left, state = hirschberg(kinds[:middle], start, crossings)
    right, state = hirschberg(kinds[middle:], state, ends)
    return left + right, state


@lru_cache(maxsize=1 << 14)
def short_way(kinds: str, start: int, ends: tuple[int, ...]) -> tuple[str, int]:
    return hirschberg(kinds, start, ends)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, gone): nulls in role and text are one space; a dropped row stays, marked gone."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy"), (F.col("fate") == 0).alias("gone"))


def row_kinds(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, kind, n): one row for each run of equal rows, with its letter and their number.

    Equal rows of a turn are counted before the shuffle; the first of a role and text is found by a grouped
    minimum over those, so a text that fills a conversation is no large group.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    state = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    runs = rows.where("NOT gone").groupBy(
        "conv_id", "turn", "role", F.xxhash64("text").alias("key"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("print"), state.alias("state"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial")).agg(F.count(F.lit(1)).alias("n"))
    # turn as a pair, so that null is the least
    runs = runs.withColumn("at", F.struct(F.when(F.col("turn").isNull(), 0).otherwise(1), F.coalesce("turn", F.lit(0))))
    first = runs.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p")).agg(F.min("at").alias("first"))
    kind = F.when(F.col("state") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("state"))
    return (runs.join(first, runs.conv_id.eqNullSafe(first.c) & (runs.role == first.r) & (runs.print == first.p))
            .select("conv_id", "turn", "role", "key", "initial", kind.alias("kind"), "n"))


def letters(initial: str, kind: str, n: int) -> tuple[str, str]:
    """(letters, faults) of ``n`` equal rows: behind the first, each repeats it."""
    code = {"blank": initial.upper(), "duplicate": initial.upper(), "truncated": initial + "t", "": initial}[kind]
    return LETTER[code] + LETTER[initial.upper()] * (n - 1), (kind[:1] or "-") + ("b" if kind == "blank" else "d") * (n - 1)


PIECE = "conv_id long, piece long, opens boolean, kinds string, faults string, costs array<long>"


def pieces(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition as one row each: letters, faults, and least costs between the states.

    Only the first and the last of a partition may go on in another one; the others are whole.
    """
    from pyspark import TaskContext

    number, now, opens = TaskContext.get().partitionId(), None, False
    kinds, faults, out = [], [], []

    def closed() -> dict:
        k = "".join(kinds)
        table = [w for p in range(4) for w in forward(k, [0 if q == p else NEVER for q in range(4)])]
        return {"conv_id": now[0], "piece": number, "opens": opens, "kinds": k, "faults": "".join(faults), "costs": table}

    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("opens", pa.bool_()), ("kinds", pa.string()), ("faults", pa.string()), ("costs", pa.list_(pa.int64()))])
    for batch in part:
        for conv, initial, kind, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "kind", "n")), strict=True):
            if now != (conv,):
                if now is not None:
                    out.append(closed())
                    opens = True  # another one ended before it in this partition
                now, kinds, faults = (conv,), [], []
            k, f = letters(initial, kind, n)
            kinds.append(k)
            faults.append(f)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def end_costs(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece with its cost to come, from the last piece of its conversation backwards (sorted so)."""
    now, ends = None, END
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("ends", pa.list_(pa.int64()))])
    for batch in part:
        out = []
        for conv, piece, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "costs")), strict=True):
            if now != (conv,):
                now, ends = (conv,), END
            out.append({"conv_id": conv, "piece": piece, "ends": list(ends)})
            ends = tuple(min(costs[4 * p + q] + ends[q] for q in range(4)) for p in range(4))
        yield pa.RecordBatch.from_pylist(out, schema)


AUDIT = "conv_id long, piece long, audits array<string>, states array<int>, faults string, kinds string"


def audits(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece with its best audit and last state: from state 0 if it opens a conversation, else from each of the four."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("faults", pa.string()), ("kinds", pa.string())])
    for batch in part:
        out = []
        for r in batch.to_pylist():
            solve = short_way if len(r["kinds"]) <= 64 else hirschberg
            ways = [solve(r["kinds"], p, tuple(r["ends"])) for p in range(1 if r["opens"] else 4)]
            out.append({"conv_id": r["conv_id"], "piece": r["piece"], "audits": [a for a, _ in ways], "states": [q for _, q in ways], "faults": r["faults"], "kinds": r["kinds"]})
        yield pa.RecordBatch.from_pylist(out, schema)


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Repair:
    """One conversation, streamed: pieces of its audit first, then its rows in order."""

    def __init__(self, conv: int | None):
        self.conv, self.audit, self.faults, self.kinds, self.state = conv, [], [], [], 0
        self.hash, self.lines, self.turns, self.at = hashlib.sha256(), 0, 0, 0
        self.low = self.high = self.last = None

    def piece(self, ways: list[str], states: list[int], faults: str, kinds: str) -> None:
        self.audit.append(ways[self.state])
        self.state = states[self.state]
        self.faults.append(faults)
        self.kinds.append(kinds)

    def started(self) -> None:
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit) + TAIL[self.state]
            self.faults, self.kinds, self.state = "".join(self.faults), "".join(self.kinds), 0

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        self.state = AFTER[self.state][role[0]]

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.write(NEW_ROLE[self.state], "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        self.started()
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.write(role if edit == "K" else NEW_ROLE[self.state], text)
        if turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1

    def result(self) -> dict:
        self.started()
        self.inserts()
        initials = self.kinds.translate(str.maketrans(dict(zip(LETTER.values(), (k[0].lower() for k in LETTER), strict=True))))
        legal = sum(initials.count(p) for p in ("su", "ua", "au"))  # their occurrences never share both rows
        cost = sum({"R": REROLE, "D": DELETE, "I": INSERT}.get(c, 0) * self.audit.count(c) for c in "RDI")
        edits = self.audit.replace("I", "")
        cost += TRUNCATED * sum(f == "t" and e != "D" for f, e in zip(self.faults, edits, strict=True))
        return {"conv_id": self.conv, "gaps": self.high - self.low + 1 - self.turns if self.turns else 0,
                **{name: self.faults.count(name[0]) for name in ("blank", "duplicate", "truncated")},
                "illegal": max(len(initials) - 1, 0) - legal, "cost": cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def repaired(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result for each conversation of a sorted partition; texts pass through, a batch at a time."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, out = None, []
    for batch in part:
        for conv, kind, turn, role, text, n_audits, states, faults, kinds in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "audits", "states", "faults", "kinds")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.result())
                now = Repair(conv)
            if kind == 0:
                now.piece(n_audits, states, faults, kinds)
            elif kind == 1:
                now.row(turn, role, text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damaged by a hash of conversation and turn, every conversation repaired by its cheapest edits; columns as ``RESULT``.

    Rows stand in order of turn (nulls first), then role, hash of the text, copy; rows alike in all are equal.
    Row letters are range-partitioned by that order, so a conversation that holds a third of all rows is cut
    into pieces of many tasks: each gives its state-to-state costs, these give every piece its cost to come,
    and all pieces are solved by themselves. One task reads the texts of a conversation, as a stream, since a
    hash of one long text has to be taken in order; it holds one character a row. Nulls in role and text are one
    space; a null conversation id is a conversation. Conversations without a row left, and an empty table, give
    zeros, an empty audit and the hash of an empty string, or no rows.
    """
    stages = Stages(conversations.sparkSession)
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = stages.table(row_kinds(rows), "row-kinds")
    order = ["conv_id", "turn", "role", "key"]
    cut = stages.table(kinds.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, PIECE), "pieces")
    ends = cut.select("conv_id", "piece", "costs").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(end_costs, "conv_id long, piece long, ends array<long>")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "ends")
    solved = stages.table(cut.join(ends, cut.conv_id.eqNullSafe(ends.c) & (cut.piece == ends.p)).drop("c", "p", "costs").mapInArrow(audits, AUDIT), "audits")
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("conv_id", F.when(F.col("gone"), 2).otherwise(1).alias("part"), "turn", "role", F.xxhash64("text").alias("key"), "copy",
                        F.when(~F.col("gone"), F.col("text")).alias("text"), none("array<string>").alias("audits"), none("array<int>").alias("states"), none("string").alias("faults"), none("string").alias("kinds"))
    heads = solved.select("conv_id", F.lit(0).alias("part"), F.col("piece").alias("turn"), none("string").alias("role"), none("long").alias("key"), F.lit(0).alias("copy"), none("string").alias("text"),
                          "audits", "states", "faults", "kinds")
    both = heads.unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "key", "copy")
    return both.mapInArrow(repaired, RESULT)


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, s: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS fate
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final FROM damaged),
rows AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
follows(p, initial, q, given) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
inserts(p, q, word, said) AS (VALUES
  (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM rows
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT r.conv_id, r.i, e.q, w.cost + 3 * length(n.word) + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
      w.audit || n.word || e.edit AS audit, list_concat(list_concat(w.said, n.said), CASE e.edit WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [e.given || ':' || r.text] ELSE [] END) AS said
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts n ON n.p = w.q
    JOIN (SELECT p, initial, q, 'K' AS edit, 0 AS cost, NULL AS given FROM follows
          UNION ALL SELECT DISTINCT p, NULL, q, 'R', 3, given FROM follows WHERE given IS NOT NULL
          UNION ALL SELECT p, NULL, p, 'D', 4, NULL FROM (VALUES (0), (1), (2), (3)) t(p)) e
      ON e.p = n.q AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.initial = r.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
best AS (
  SELECT w.conv_id, w.cost + 3 * length(n.word) AS cost, w.audit || n.word AS audit, list_concat(w.said, n.said) AS said
  FROM ways w JOIN inserts n ON n.p = w.q AND n.q IN (0, 3) JOIN (SELECT DISTINCT conv_id, n FROM rows) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(n.word), w.audit || n.word) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
