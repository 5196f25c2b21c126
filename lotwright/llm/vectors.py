"""Vector codes: product quantization learned on distinct integer parts.

A component x becomes the integer floor(4096 * x), and a vector PARTS consecutive
parts. Each part position has a codebook of its own.

1. Equal parts of a position are one row with its count, so a vector that a third of
   all rows hold is one row, and each round of Lloyd reads distinct parts alone.
2. A round assigns each distinct part to the nearest entry and adds up parts times
   counts. A task sums what it reads and sends one row for each entry's component;
   the sums are added exactly, and an entry becomes their floored mean. The driver
   holds the codebooks, ENTRIES vectors.
3. The codes of distinct parts are joined back to the vectors by position and part.

Arithmetic is exact at any size: 64-bit integers where the values allow it, Python's
elsewhere; sums cross the network in two decimals.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped; shorter vectors, and lengths that PARTS doesn't divide, are filled up with
zeros; of fewer vectors than ENTRIES all are entries; of equal vec_ids the lesser
vector comes first, null ids come last; repeated rows each give a row; an error
beyond a long is the greatest long; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE = 4096
PARTS = 8
#: At most 128, so that PARTS codes of two hexadecimal digits are a long.
ENTRIES = 16
ROUNDS = 6
MOST = (1 << 63) - 1
#: Sums are sent as high * SPLIT + low.
SPLIT = 1 << 60

Codebooks = list[list[list[int]]]


def _whole(x: Column) -> Column:
    """floor(SCALE * x) as a double, which holds it exactly; beyond 2**53 doubles are whole."""
    y = x.cast("double") * F.lit(float(SCALE))
    return F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y)


def _kept(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.filter(F.coalesce(finite, F.lit(False))).select("vec_id", "label", F.transform("embedding", _whole).alias("whole"))


def split(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Stored rows (rid, vec_id, label, parts): the kept vectors, each cut into `parts` arrays of whole numbers."""
    kept = common.store(_kept(vectors), "vector-whole")
    width = -(-(kept.agg(F.max(F.size("whole"))).first()[0] or 0) // parts)
    filled = F.concat("whole", F.array_repeat(F.lit(0.0), F.lit(width * parts) - F.size("whole")))
    cut = F.array(*[F.slice(filled, q * width + 1, width) for q in range(parts)])
    return common.store(kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", cut.alias("parts")), "vector-parts")


def _whole_numbers(parts: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Parts and entries as 64-bit integers if no squared distance overflows those, else as Python's."""
    x, width = np.stack(parts), len(entries[0])
    most = int(max(np.abs(x).max(initial=0.0), 0)) + max((abs(c) for e in entries for c in e), default=0)
    if most * most * max(width, 1) <= MOST:
        return x.astype(np.int64), np.array(entries, np.int64).reshape(len(entries), width)
    exact = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(len(x), width)
    return exact, np.array(entries, object).reshape(len(entries), width)


def nearest(parts: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index of each part's nearest entry (the lower of equals), the squared distance, and the parts as integers."""
    x, books = _whole_numbers(parts, entries)
    best, far = np.zeros(len(x), np.int64), ((x - books[0]) ** 2).sum(axis=1)
    for k in range(1, len(books)):
        d = ((x - books[k]) ** 2).sum(axis=1)
        closer = (d < far).astype(bool)
        best[closer], far[closer] = k, d[closer]
    return best, far, x


def _sums(codebooks: Codebooks):
    """Rows (q, k, i, high, low): of a task's parts at position q nearest to entry k the sum of component i; i = -1 is their number."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for q, rows in batch.groupby("q"):
                best, _, x = nearest(rows["part"].to_numpy(), codebooks[q])
                n = rows["n"].to_numpy()
                small = x.dtype == np.int64 and int(np.abs(x).max(initial=1)) * int(n.sum()) <= MOST
                weighted = x * n[:, None] if small else x.astype(object) * n.astype(object)[:, None]
                for k in np.unique(best).tolist():
                    mine = [int(n[best == k].sum()), *map(int, weighted[best == k].sum(axis=0))]
                    known = total.get((q, k))
                    total[q, k] = [a + b for a, b in zip(known, mine, strict=True)] if known else mine
        rows = [(q, k, i - 1, Decimal(v // SPLIT), Decimal(v % SPLIT)) for (q, k), sums in total.items() for i, v in enumerate(sums)]
        yield pd.DataFrame(rows, columns=["q", "k", "i", "high", "low"])

    return make


def learned(distinct: DataFrame, codebooks: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after weighted Lloyd rounds over the stored rows (q, part, n)."""
    for _ in range(rounds):
        sums = distinct.mapInPandas(_sums(codebooks), "q int, k int, i int, high decimal(38,0), low decimal(38,0)")
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.groupBy("q", "k", "i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            found.setdefault((r.q, r.k), {})[r.i] = int(r.high) * SPLIT + int(r.low)
        codebooks = [
            [[found[q, k][i] // found[q, k][-1] for i in range(len(entry))] if (q, k) in found else entry for k, entry in enumerate(book)]
            for q, book in enumerate(codebooks)
        ]
    return codebooks


def _codes(codebooks: Codebooks):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, rows in batch.groupby("q"):
                best, far, _ = nearest(rows["part"].to_numpy(), codebooks[q])
                yield pd.DataFrame({"q": rows["q"].to_numpy(), "part": rows["part"].to_numpy(), "k": best, "far": [min(int(d), MOST) for d in far.tolist()]})

    return make


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Rows (vec_id, label, code, error) of the kept vectors, and the codebooks by position and entry."""
    rows = split(vectors, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    codebooks = [[[int(x) for x in r.parts[q]] for r in first] for q in range(parts)]
    each = rows.select("rid", "vec_id", "label", F.posexplode("parts").alias("q", "part"))
    distinct = common.store(each.groupBy("q", "part").agg(F.count("*").alias("n")), "vector-distinct")
    codebooks = learned(distinct, codebooks, rounds)
    coded = distinct.mapInPandas(_codes(codebooks), "q int, part array<double>, k int, far long")
    joined = each.join(coded, ["q", "part"])
    code = F.sum(F.call_function("shiftleft", F.col("k").cast("long"), F.lit(8) * (parts - 1 - F.col("q"))))
    error = F.least(F.sum(F.col("far").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    made = joined.groupBy("rid", "vec_id", "label").agg(code.alias("code"), error.alias("error"))
    made = made.select("vec_id", "label", F.lpad(F.lower(F.hex("code")), 2 * parts, "0").alias("code"), "error")
    return made, codebooks


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by position, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors of `embeddings`; the module's defined cases hold."""
    made, codebooks = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    made = common.store(made, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    of = made.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    joined = made.join(of, made["label"].eqNullSafe(of["of_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _lloyd_sql(r: int) -> str:
    """One round: parts get their nearest entry of codebook b{r-1}, entries become floored means in b{r}."""
    return f"""
a{r} AS MATERIALIZED (SELECT q, part, n, arg_min(k, far * 16 + k) AS k FROM (
  SELECT d.q, d.part, d.n, b.k, list_sum(list_transform(list_zip(d.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
  FROM d JOIN b{r - 1} b USING (q)) GROUP BY q, part, n),
s{r} AS (SELECT q, k, i, sum(part[i] * n) AS s, sum(n) AS n FROM a{r}, generate_series(1, 8) AS g(i) GROUP BY q, k, i),
m{r} AS (SELECT q, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM s{r} GROUP BY q, k),
b{r} AS MATERIALIZED (SELECT q, k, CAST(coalesce(m.entry, b.entry) AS BIGINT[]) AS entry FROM b{r - 1} b LEFT JOIN m{r} m USING (q, k)),"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, q, w[q * 8 + 1 : q * 8 + 8] AS part FROM v, generate_series(0, 7) AS g(q)),
d AS MATERIALIZED (SELECT q, part, count(*) AS n FROM p GROUP BY q, part),
f AS (SELECT w, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM (SELECT * FROM v ORDER BY vec_id LIMIT 16)),
b0 AS MATERIALIZED (SELECT q, k, w[q * 8 + 1 : q * 8 + 8] AS entry FROM f, generate_series(0, 7) AS g(q)),{"".join(map(_lloyd_sql, range(1, 7)))}
e AS MATERIALIZED (SELECT q, part, min(far * 16 + k) AS m FROM (
  SELECT d.q, d.part, b.k, list_sum(list_transform(list_zip(d.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
  FROM d JOIN b6 b USING (q)) GROUP BY q, part),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', CAST(m % 16 AS BIGINT)), '' ORDER BY q) AS code, CAST(sum(m // 16) AS BIGINT) AS error
  FROM p JOIN e USING (q, part) GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY q, k)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h
"""
