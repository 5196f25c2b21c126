"""Suffix arrays and the removal of repeated byte strings, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, prose

from lotwright.llm import repeats, suffixes


def flat(strings):
    strings = sorted(strings, key=len, reverse=True)
    return np.concatenate([np.append(s, 0) for s in strings]).astype(np.uint16), np.array([len(s) + 1 for s in strings])


def check_arrays(strings, most=7):
    text, lengths = flat(strings)
    array = suffixes.arrays(text, lengths)
    prefix = suffixes.permuted_prefixes(text, lengths, array, most)
    start = 0
    for n in lengths.tolist():
        own = text[start : start + n].tolist()
        want = sorted(range(n), key=lambda i: own[i:])
        assert (array[start : start + n] - start).tolist() == want
        for i, j in zip(want, want[1:], strict=False):
            common = next((k for k in range(n) if max(i, j) + k >= n or own[i + k] != own[j + k]), n)
            assert prefix[start + j] == min(common, most)
        start += n


def test_arrays():
    rng = np.random.default_rng(3)
    for _ in range(60):
        check_arrays([rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)) for _ in range(rng.integers(1, 8))])


@pytest.mark.parametrize("strings", [[np.ones(300, int)], [np.array([1, 2] * 150), np.array([3, 2, 1] * 60), np.array([1])], [np.arange(1, 200)], [np.arange(200, 1, -1)]])
def test_arrays_of_patterns(strings):
    check_arrays(strings, most=90)


def plain(rows, window=repeats.WINDOW):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[s : s + window] for _, b in texts for s in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def quoting(n):
    """Documents that quote a passage between words of their own, near copies, and letters that repeat."""
    passage, near = prose(5, 70), prose(6, 200)
    rows = [(i, f"{prose(100 + i, 30 + i % 7)} {passage} {prose(200 + i, 30)}") for i in range(n)]
    rows += [(n + i, near[: 97 * i % len(near)] + "#" * (i % 3) + near[97 * i % len(near) :]) for i in range(n)]
    rows += [(2 * n, "x" * 3000), (2 * n + 1, "ab" * 900 + "c"), (2 * n + 2, prose(7, 20) * 2), (2 * n + 3, "é♥𝒳" * 200)]
    random.Random(1).shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def quoted(spark):
    rows = quoting(25)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_removal(docs, rows):
    assert got(repeats.removed(docs)) == plain(rows)


def test_removal_in_one_round(quoted):
    assert got(repeats.removed(quoted[1])) == plain(quoted[0])


@pytest.mark.parametrize("string_bytes", [1500, 6000])
def test_runs_of_hot_keys_go_through_further_rounds(quoted, string_bytes):
    assert got(repeats.removed(quoted[1], string_bytes=string_bytes, pack_bytes=20_000)) == plain(quoted[0])


def test_kept_bytes(quoted):
    for r in repeats.removed(quoted[1], with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_segments_and_borders():
    raw = np.frombuffer(prose(9, 60_000).encode(), np.uint8)
    lengths = np.array([500, 0, 399, 400, len(raw) - 1299])
    first, count, _ = repeats.runs_of(raw, lengths, 128)
    inside = [s for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True) for s in range(e - n, e - 399)]
    assert sorted(p for f, c in zip(first.tolist(), count.tolist(), strict=True) for p in range(f, f + c)) == inside


def test_no_rows_and_clashing_columns(nothing, clashing, rows):
    assert repeats.removed(nothing).collect() == []
    renamed = clashing.withColumnsRenamed({"text_sha256": "at", "fp": "digest", "id": "bits", "k_id": "data"})
    assert got(repeats.removed(renamed)) == plain(rows)
