"""Codes of vectors against plain integer Lloyd over all rows."""

import hashlib
import math
import random
from collections import Counter

import pytest

from lotwright.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n=200, width=16, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.25, -0.5, -0.0]) for _ in range(width)], None if i % 11 == 0 else i % 4) for i in range(n)]
    rows += [(n + i, [0.125] * width, 2) for i in range(60)] + [(5, [0.5] * width, 1), (5, [0.5] * width, 1), (None, [0.75] * width, None)]
    return rows + [(-1, None, 1), (-2, [None] + [0.0] * (width - 1), 1), (-3, [float("nan")] * width, 1), (-4, [float("inf")] + [0.0] * (width - 1), None), (-5, [-float("inf")] * width, 3)]


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows):
    kept = [(i, [math.floor(4096 * single(x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), g) for i, v, g in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    cut = lambda v, q: v[q * width : (q + 1) * width]
    books = [[cut(v, q) for _, v, _ in first] for q in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, book: min((far(p, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for q in range(8):
            mine = [(near(cut(v, q), books[q])[1], cut(v, q)) for _, v, _ in kept]
            for k in range(len(books[q])):
                parts = [p for j, p in mine if j == k]
                if parts:
                    books[q][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, total = [], Counter()
    for i, v, g in kept:
        best = [near(cut(v, q), books[q]) for q in range(8)]
        error = min(sum(min(d, V.MOST) for d, _ in best), V.MOST)
        total[g] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, g))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, min(total[g], V.MOST), sha) for i, c, e, g in out), key=str)


def run(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{path}/embeddings.parquet")
    return sorted((tuple(r) for r in V.op13_vector_codes(spark, f"file://{path}").collect()), key=str)


@pytest.mark.parametrize("rows", [made(), made(20, 8, 2)[:9], made(60, 5, 3), made(40, 24, 4) + [(1000, [1.0] * 3, 7), (1001, [], 7)]], ids=["ties", "few", "filled", "ragged"])
def test_codes(spark, rows, tmp_path):
    assert run(spark, rows, tmp_path) == plain(rows)


def test_values_beyond_64_bits(spark, tmp_path):
    rows = made(40) + [(500 + i, [(-1) ** i * 3e38 / (1 + i % 3)] * 16, 9) for i in range(20)] + [(600, [1e12] * 16, 9)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_no_vectors(spark, tmp_path):
    assert run(spark, [(1, None, 1)], tmp_path / "a") == []
    assert run(spark, [], tmp_path / "b") == []


def test_clashing_columns(spark, tmp_path):
    rows = made(30)
    more = [(*r, "clash", "clash", "clash", "clash") for r in rows]
    assert run(spark, more, tmp_path, SCHEMA + ", rid string, q string, part string, code string") == plain(rows)
