"""Repair of the turn structure of conversations.

A conversation is well formed if the initials of its roles read (s?(ua)+)?. Rows are
kept, given another role or deleted, and rows without text inserted, at the least cost;
of equal costs the edits whose initials (D, I, K, R) come first in ASCII stay.

The cheapest repair is a dynamic programme over retained rows. Between a retained row
and the next all rows are deleted, which prefix sums of deletions price; the two roles
determine what must be inserted between them; so of all next rows only the running
minimum for each role is needed. The minima run from the last row to the first: then
two repairs of equal cost differ first in the edits nearest by, where the longer gap
(a D more) and else the lesser letters win, and no audit need be compared.

1. Rows equal in conversation, turn, role and text are counted before anything is sorted.
   What a role and text were first seen at is found by digests of those that recur.
2. Rows are dealt by range of (conversation, turn, role, text) and sorted, so a task
   reads whole conversations, or pieces of one that lies on a range's edge or has more
   rows or bytes than a piece may have. A whole conversation is repaired at once.
3. A piece gives, for each state that it may be entered and left in, the cost and the
   place of its audit among those from the same entry. The pieces of a conversation
   are then chained by these few numbers, and each repaired with the states found.
4. Hashes and audits of conversations in pieces are joined up in order, piece by piece.
   A conversation's audit and hash are one value each, so this step alone reads a
   conversation in one task, a piece at a time.

Defined cases: null role or text is one space; null turns come first, and a null
conv_id is a conversation; rows of equal turn are in order of role, then text; a role
counts by its first letter, and one without (an empty role) is illegal beside any; a
conversation without rows after damage has zeros and an empty audit; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
PIECE_ROWS, PIECE_BYTES = 1 << 14, 1 << 22
BLANK_ROW, COPY_ROW, CUT_ROW = 1, 2, 3
#: States: nothing retained, or the role of the last retained row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Rows that must be inserted between a state and a next role; a system row follows nothing.
BETWEEN = {(NOTHING, SYSTEM): 0, (NOTHING, USER): 0, (NOTHING, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
#: Rows that must be inserted after the last retained one.
AT_END = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


# --- damage and faults ---------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n): the table after damage, n copies of each."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(harm == 1, F.lit("")).when(harm == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(harm == 4, F.lit("user")).otherwise(spaced("role"))
    hurt = rows.filter(harm != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(harm == 3, 2).otherwise(1).alias("n"))
    return hurt.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def _order(turn: Column) -> Column:
    """Turns in order, null before all."""
    return F.struct(turn.isNotNull().alias("some"), turn.alias("turn"))


def faulty(rows: DataFrame) -> DataFrame:
    """Rows with `fault`, that of the first of n copies: 0 none, BLANK_ROW, COPY_ROW or CUT_ROW."""
    digest = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)
    keyed = rows.withColumn("key", digest)
    seen = keyed.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(_order(F.col("turn"))).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    joined = keyed.join(seen, keyed["conv_id"].eqNullSafe(F.col("c")) & (keyed["key"] == F.col("k")), "left")
    bare = F.rtrim(F.col("text"), F.lit(common.SPACES))
    fault = (
        F.when(bare == "", BLANK_ROW)
        .when(F.col("first").isNotNull() & (_order(F.col("turn")) > F.col("first")), COPY_ROW)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_ROW)
        .otherwise(0)
    )
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


# --- the dynamic programme ----------------------------------------------


class Rows:
    """Consecutive rows of a conversation, those in copies told once with their number."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], copies: list[int], faults: list[int]):
        self.turns, self.roles, self.texts, self.copies, self.faults = turns, roles, texts, copies, faults
        self.gone = list(accumulate(copies, initial=0))

    def options(self, j: int) -> list[tuple[int, str, int]]:
        """(state, letter, cost) in which row j may be retained; of copies the first."""
        if self.faults[j] in (BLANK_ROW, COPY_ROW):
            return []
        extra = TRUNCATED if self.faults[j] == CUT_ROW else 0
        own = INITIALS.get(self.roles[j][:1])
        out = [(own, "K", extra)] if own is not None else []
        return out + [(s, "R", extra + REROLE) for s in ROLES if s != own]

    def solve(self, ends: dict[int, int]) -> tuple[list[int], list[dict[int, tuple[int, int, str] | None]]]:
        """Costs by entry state, and for each retained row and state the next retained (row, state, letter).

        `ends` has the cost of what follows by the state at the end; steps[j][s] is the choice
        after row j retained in state s, steps[-1] that of the entries; None deletes the rest.
        """
        n, total = len(self.roles), self.gone[-1]
        best: dict[int, tuple[int, int, str]] = {}  # by role: least of cost + DELETE * rows before, its row and letter
        steps: list = [None] * (n + 1)

        def choose(state: int, at: int) -> tuple[int, tuple[int, int, str] | None]:
            """The cheapest way on from `state` after `at` rows."""
            chosen, least, key = None, ends.get(state, FAR) + DELETE * (total - at), (-n, "")
            for role, (cost, j, letter) in best.items():
                between = BETWEEN.get((state, role))
                if between is None:
                    continue
                c, k = cost + INSERT * between - DELETE * at, (-j, "I" * between + letter)
                if c < least or (c == least and k < key):
                    chosen, least, key = (j, role, letter), c, k
            return least, chosen

        for j in range(n - 1, -1, -1):
            retained = [(state, letter, cost, *choose(state, self.gone[j] + 1)) for state, letter, cost in self.options(j)]
            steps[j] = {state: step for state, _, _, _, step in retained}
            for state, letter, cost, on, _ in retained:
                sum_ = cost + on + DELETE * self.gone[j]
                # of equal costs that of the earlier row is worse: the longer gap has a D where it has a letter
                if on < FAR and (state not in best or sum_ < best[state][0]):
                    best[state] = (sum_, j, letter)
        entries = [choose(s, 0) for s in range(4)]
        steps[n] = {s: step for s, (_, step) in enumerate(entries)}
        return [min(c, FAR) for c, _ in entries], steps

    def path(self, entry: int, steps: list) -> tuple[str, list[tuple[int | None, int]], int]:
        """Audit, retained or inserted rows (row or None, state) in order, and the state at the end."""
        audit, out, at, state, step = [], [], 0, entry, steps[-1][entry]
        while step is not None:
            j, role, letter = step
            audit.append("D" * (self.gone[j] - at))
            for _ in range(BETWEEN[state, role]):
                audit.append("I")
                out.append((None, USER if role == ASSISTANT else ASSISTANT))
            audit.append(letter)
            out.append((j if letter == "K" else ~j, role))
            at, state, step = self.gone[j] + 1, role, steps[j][role]
        audit.append("D" * (self.gone[-1] - at))
        return "".join(audit), out, state

    def lines(self, out: list[tuple[int | None, int]]) -> list[str]:
        """role:text of the rows of a path; ~row is one with another role."""
        return [f"{ROLES[s]}:" if j is None else f"{self.roles[j]}:{self.texts[j]}" if j >= 0 else f"{ROLES[s]}:{self.texts[~j]}" for j, s in out]

    def stats(self) -> dict[str, int | str | None]:
        """What the result counts, and what must be known of the ends to add up pieces."""
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        pairs = sum(a + b not in LEGAL for a, b in pairwise(initials))
        pairs += sum((n - 1) * (a + a not in LEGAL) for a, n in zip(initials, self.copies, strict=True))
        count = lambda fault: sum(n if fault == BLANK_ROW else 1 for n, f in zip(self.copies, self.faults, strict=True) if f == fault)
        copies = count(COPY_ROW) + sum(n - 1 for n, f in zip(self.copies, self.faults, strict=True) if f != BLANK_ROW)
        distinct = sum(a != b for a, b in zip(known, [None, *known], strict=False))
        return {
            "blank": count(BLANK_ROW), "duplicate": copies, "truncated": count(CUT_ROW), "illegal": pairs, "first_initial": initials[0], "last_initial": initials[-1],
            "least_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": distinct,
        }


def _end_lines(state: int) -> list[str]:
    return [f"{ROLES[r]}:" for r in (USER, ASSISTANT)[2 - AT_END[state] :]]


def repaired(rows: Rows) -> tuple[int, str, list[str]]:
    """Cost, audit and lines of a whole conversation."""
    costs, steps = rows.solve({s: INSERT * n for s, n in AT_END.items()})
    audit, out, state = rows.path(NOTHING, steps)
    return costs[NOTHING], audit + "I" * AT_END[state], rows.lines(out) + _end_lines(state)


# --- pieces of long conversations ---------------------------------------

STATS = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first_initial": "string", "last_initial": "string", "least_turn": "long", "last_turn": "long", "turns": "long"}
BODY = {"row_turns": "array<long>", "roles": "array<string>", "texts": "array<string>", "copies": "array<long>", "faults": "array<int>"}
PIECE = {"conv_id": "long", "seq": "long", "whole": "boolean", "cost": "long", "audit": "string", "repaired_sha256": "string"} | STATS | {"ways": "array<long>"} | BODY


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _arrow(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kind = lambda t: pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t]
    arrays = [pa.array([r[i] for r in rows], kind(t)) for i, t in enumerate(columns.values())]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _ways(rows: Rows) -> list[int]:
    """For each entry and exit state the cost, and the place of its audit among those of the entry: cost * 4 + place, or -1 for no way."""
    runs = {x: rows.solve({x: 0}) for x in range(4)}
    out = []
    for entry in range(4):
        audits = {x: rows.path(entry, steps)[0] for x, (costs, steps) in runs.items() if costs[entry] < FAR}
        place = {x: k for k, x in enumerate(sorted(audits, key=audits.get))}
        out += [4 * runs[x][0][entry] + place[x] if x in place else -1 for x in range(4)]
    return out


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Whole conversations with their repair, and pieces of those on a range's edge or too long for one."""

    def row(conv_id: int | None, held: list[tuple], number: int, edge: bool) -> tuple:
        r = Rows(*map(list, zip(*held, strict=True)))
        seq, stats = (TaskContext.get().partitionId() << 32) + number, list(r.stats().values())
        if edge:
            return (conv_id, seq, False, None, None, None, *stats, _ways(r), r.turns, r.roles, r.texts, r.copies, r.faults)
        cost, audit, lines = repaired(r)
        return (conv_id, seq, True, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), *stats, *[None] * 6)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first conversation of a task may have begun in the one before
        held, size, current, number, cut, out = [], 0, None, 0, True, []
        for batch in batches:
            for conv_id, *values in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")], strict=True):
                if held and (conv_id != current or len(held) >= piece_rows or size >= piece_bytes):
                    cut = cut or conv_id == current
                    out.append(row(current, held, number, cut))
                    number, held, size, cut = number + 1, [], 0, conv_id == current
                    if len(out) >= 256 or not out[-1][2]:
                        yield _arrow(out, PIECE)
                        out = []
                current = conv_id
                held.append(tuple(values))
                size += len(values[2])
        if held:
            out.append(row(current, held, number, True))  # and the last may go on in the next
        if out:
            yield _arrow(out, PIECE)

    dealt = rows.repartitionByRange(F.col("conv_id"), _order(F.col("turn")), "role", "text")
    return dealt.sortWithinPartitions("conv_id", _order(F.col("turn")), "role", "text").mapInArrow(make, _schema(PIECE))


CHAIN = {"conv_id": "long", "seq": "long", "entry": "int", "leave": "int", "last": "boolean"} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "long")


def chained(part: pa.Table) -> pa.Table:
    """Entry and exit states of all pieces of a conversation, and what the conversation comes to."""
    rows = sorted(part.to_pylist(), key=lambda r: r["seq"])
    after, choice = [INSERT * AT_END[s] for s in range(4)], []
    for r in reversed(rows):
        picked = [min((w // 4 + after[x], w % 4, x) for x, w in enumerate(r["ways"][4 * e : 4 * e + 4]) if w >= 0) for e in range(4)]
        after = [cost for cost, _, _ in picked]
        choice.append([leave for _, _, leave in picked])
    known = [r for r in rows if r["least_turn"] is not None]
    turns = sum(r["turns"] for r in known) - sum(a["last_turn"] == b["least_turn"] for a, b in pairwise(known))
    gaps = known[-1]["last_turn"] - known[0]["least_turn"] + 1 - turns if known else 0
    illegal = sum(r["illegal"] for r in rows) + sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in pairwise(rows))
    total = (gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, after[NOTHING])
    out, state = [], NOTHING
    for r, leave in zip(rows, reversed(choice), strict=True):
        out.append((r["conv_id"], r["seq"], state, leave[state], r is rows[-1], *total))
        state = leave[state]
    return pa.Table.from_batches([_arrow(out, CHAIN)])


REBUILT = {"conv_id": "long", "seq": "long", "last": "boolean", "audit": "string", "lines": "array<string>"}
JOINED = {"conv_id": "long", "audit": "string", "repaired_sha256": "string"}


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired lines of each piece, with the states it is entered and left in."""
    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            r = Rows(*[p[c] for c in BODY])
            audit, out, _ = r.path(p["entry"], r.solve({p["leave"]: 0})[1])
            lines = r.lines(out)
            if p["last"]:
                audit, lines = audit + "I" * AT_END[p["leave"]], lines + _end_lines(p["leave"])
            yield _arrow([(p["conv_id"], p["seq"], p["last"], audit, lines)], REBUILT)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations whose pieces come one after the other."""
    digest, audit, begun = hashlib.sha256(), [], False
    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            for line in p["lines"]:
                digest.update(("\n" * begun + line).encode())
                begun = True
            audit.append(p["audit"])
            if p["last"]:
                yield _arrow([(p["conv_id"], "".join(audit), digest.hexdigest())], JOINED)
                digest, audit, begun = hashlib.sha256(), [], False


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The damage, faults and cheapest repair of every conversation."""
    made = common.store(pieces(faulty(damaged(conversations)), piece_rows, piece_bytes), "conversation-pieces")
    span = F.coalesce(F.col("last_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0))
    whole = made.filter("whole").select("conv_id", span.alias("gaps"), *FIELDS[1:], "audit", "repaired_sha256")
    parts = made.filter("not whole")
    light = parts.select("conv_id", "seq", *STATS, "ways")
    chain = common.store(light.groupBy("conv_id").applyInArrow(chained, _schema(CHAIN)), "conversation-chain")
    states = chain.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "entry", "leave", "last")
    entered = parts.select("conv_id", "seq", *BODY).join(states, F.col("seq") == F.col("s")).drop("c", "s")
    rebuilt = entered.mapInArrow(_rebuilt, _schema(REBUILT))
    hashed = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_joined, _schema(JOINED))
    totals = chain.filter("last").select(F.col("conv_id").alias("c"), *FIELDS)
    whole = whole.unionByName(hashed.join(totals, hashed["conv_id"].eqNullSafe(totals["c"])).drop("c"))
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    none = {c: F.lit(0).cast("long") for c in FIELDS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    out = every.join(whole, every["id"].eqNullSafe(whole["conv_id"]), "left")
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), empty).alias(c) for c, empty in none.items()])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of all conversations; the module's defined cases hold."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS harm
  FROM named, tab),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM harmed WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM rows_),
judged AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS ini,
    CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed),
between_(f, t, i, lines) AS (VALUES ('b', 's', 0, []), ('b', 'u', 0, []), ('b', 'a', 1, ['user:']), ('s', 'u', 0, []), ('s', 'a', 1, ['user:']),
  ('u', 'u', 1, ['assistant:']), ('u', 'a', 0, []), ('a', 'u', 0, []), ('a', 'a', 1, ['user:'])),
moves AS MATERIALIZED (
  SELECT f, t, kept, repeat('I', i) || CASE WHEN kept THEN 'K' ELSE 'R' END AS letters, 5 * i + CASE WHEN kept THEN 0 ELSE 1 END AS cost, lines
  FROM between_, (VALUES (TRUE), (FALSE)) AS x(kept) WHERE kept OR t <> 's'
  UNION ALL SELECT f, f, NULL, 'D', 2, [] FROM (VALUES ('b'), ('s'), ('u'), ('a')) AS x(f)),
states AS (
  SELECT DISTINCT conv_id, 0 AS k, 'b' AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM judged
  UNION ALL
  SELECT conv_id, k, st, cost, audit, lines FROM (
    SELECT s.conv_id, r.k, m.t AS st, s.cost + m.cost + CASE WHEN m.kept IS NOT NULL AND r.fault = 3 THEN 5 ELSE 0 END AS cost, s.audit || m.letters AS audit,
      CASE WHEN m.kept IS NULL THEN s.lines ELSE list_concat(s.lines, list_append(m.lines, CASE WHEN m.kept THEN r.role WHEN m.t = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text)) END AS lines
    FROM states s JOIN judged r ON r.conv_id = s.conv_id AND r.k = s.k + 1 JOIN moves m ON m.f = s.st
    WHERE m.kept IS NULL OR (r.fault NOT IN (1, 2) AND (NOT m.kept OR m.t = r.ini)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
last_ AS (SELECT conv_id, max(k) AS k FROM judged GROUP BY 1),
ended AS (
  SELECT conv_id, cost + 5 * len(more) AS cost, audit || repeat('I', len(more)) AS audit, list_concat(lines, more) AS lines
  FROM states JOIN last_ USING (conv_id, k) JOIN (VALUES ('b', []), ('s', ['user:', 'assistant:']), ('u', ['assistant:']), ('a', [])) AS e(st, more) USING (st)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + 5 * len(more), audit || repeat('I', len(more))) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN ended USING (conv_id)
"""
