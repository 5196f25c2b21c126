"""Repair of conversations against every possible repair, whole and in pieces; and the query by its SQL's rules."""

import hashlib
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lotwright.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Same.", "Same.", "Ünï."]


def made(n, long):
    rows, x = [], 7
    for c in range(n):
        for t in range(long if c == 3 else 1 + c % 7):
            x = (x * 1103515245 + 12345) % (1 << 31)
            role = ["user", "assistant", "system", "tool", "user", "assistant", "", "User"][(x >> 9) % 8]
            rows.append((c, None if (x >> 5) % 17 == 0 else t - t % 3 % 2, role, TURNS[(x >> 13) % len(TURNS)]))
    return rows + [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", None), (900, 5, "user", "A."), (900, 5, "user", "A.")]


def harmed(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x
        out += [(c, t, "user" if harm == 4 else r, x)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def plain(rows):
    """Dynamic programme over all edits row by row, audits compared whole."""
    every = {r[0] for r in rows}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    done = {c: list(g) for c, g in groupby(sorted(harmed(rows), key=order), key=lambda r: r[0])}
    return {c: repair(done.get(c, [])) for c in every}


LINK = {("", "s"): [], ("", "u"): [], ("", "a"): ["user:"], ("s", "u"): [], ("s", "a"): ["user:"], ("u", "u"): ["assistant:"], ("u", "a"): [], ("a", "u"): [], ("a", "a"): ["user:"]}
END = {"": [], "s": ["user:", "assistant:"], "u": ["assistant:"], "a": []}


def repair(rows):
    seen, faults = set(), []
    for _, _, r, x in rows:
        bare = x.rstrip(" \t\n\x0b\f\r")
        faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    best = {"": (0, "", [])}
    for (_, _, r, x), f in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit, lines) in best.items():
            options = [(s, cost + 2, audit + "D", lines)]
            if f not in ("b", "d"):
                for to, letter, c, role in [(r[:1], "K", 0, r), ("u", "R", 1, "user"), ("a", "R", 1, "assistant")]:
                    if (s, to) in LINK and to:
                        more = LINK[s, to]
                        options.append((to, cost + c + 5 * len(more) + 5 * (f == "t"), audit + "I" * len(more) + letter, [*lines, *more, f"{role}:{x}"]))
            for to, *value in options:
                if to not in new or value[:2] < list(new[to][:2]):
                    new[to] = tuple(value)
        best = new
    cost, audit, lines = min((c + 5 * len(END[s]), a + "I" * len(END[s]), x + END[s]) for s, (c, a, x) in best.items())
    turns, roles = [r[1] for r in rows if r[1] is not None], [r[2][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.fixture(scope="module")
def chats(spark):
    rows = made(40, 120)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_whole(chats):
    assert got(C.repair(chats[1])) == plain(chats[0])


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces(chats, piece):
    assert got(C.repair(chats[1], piece_rows=piece)) == plain(chats[0])


def test_pieces_of_few_bytes(chats):
    assert got(C.repair(chats[1], piece_bytes=8)) == plain(chats[0])


def test_very_long_texts_and_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(5000)] + [(2, 0, "user", "x" * 200_000 + "."), (2, 1, "assistant", "y" * 200_000)]
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA), piece_rows=700)) == plain(rows)


def test_no_rows_and_clashing_columns(spark, chats):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    more = chats[1].select("*", *[F.lit("clash").alias(c) for c in ("c", "k", "key", "n", "seq", "fault", "first", "id", "s")])
    assert got(C.repair(more)) == plain(chats[0])


def test_query(spark, chats, tmp_path):
    chats[1].write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert got(C.op11_conversation_repair(spark, f"file://{tmp_path}")) == plain(chats[0])
