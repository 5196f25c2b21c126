"""Removal of long byte strings that occur more than once, by suffix arrays.

A window is WINDOW consecutive bytes of a document. Every byte covered by a window
whose bytes also start anywhere else, in the same document or another, is removed,
windows being judged on the input.

1. Texts go once into packs of a few megabytes. A window is anchored at the gram in it
   whose hash is least, the leftmost of equals, so equal windows have equal grams at
   equal places. Windows in a row with one anchor are a run, and the anchor's hash is
   its key: on average a run covers half as many windows as a window has grams.
2. Keys are counted. Only runs whose key occurs twice can hold a repeated window; their
   bytes are sent once for each different run of a pack, and equal runs are counted.
3. Different runs of a key are one string. Strings get suffix arrays by induced sorting
   (`suffixes`) and the permuted common prefixes; neighbours with a prefix of WINDOW
   bytes or more are the same window, and one that occurs twice is repeated.
4. A key may have many different runs, such as the neighbourhood of a passage that half
   of all documents quote. The runs of keys with more than STRING_BYTES become texts of
   another round with longer grams, and so fewer windows a run; the last grams are whole
   windows, whose keys have one run each.
5. Packs mark the covered bytes.

So texts are shuffled twice, runs only where they may repeat, and no string, bucket or
list grows with the copies of a text: a run that all packs hold is a row from each.

Defined cases: a null text is empty; a text shorter than a window stays; rows of equal
doc_id are documents of their own; bytes that aren't UTF-8 are compared like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, suffixes

WINDOW = 400
#: Lengths of the grams of each round; the last is a window.
GRAMS = (128, 320, WINDOW)
PACK_BYTES = 4_000_000
#: A string of runs of one key has at most this many bytes, but in the last round.
STRING_BYTES = 1 << 16
#: Bytes of runs that a task gets at once, and characters that are sorted side by side.
BUCKET_BYTES = 8_000_000
BATCH = 1 << 21
SEGMENT = 1 << 20
DIGEST = 16

U = np.uint64
PLACE_BITS = 21  # of a position in a segment and the window that reaches out of it

RUNS = "p long, at array<int>, key long, digest binary, n long, data binary"
ANSWER = "digest binary, bits binary"


# --- runs ----------------------------------------------------------------


class _Grams:
    """Hashes of all grams of a segment, from running sums."""

    def __init__(self, seed: int = 12):
        rng, size = np.random.default_rng(seed), SEGMENT + WINDOW
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        base, made = int(rng.integers(1 << 40, 1 << 62)) | 1, []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        self.up, self.down = made

    def __call__(self, raw: np.ndarray, gram: int) -> np.ndarray:
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[raw] * self.up[:n], out=sums[1:])
        x = (sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1]
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_grams: list[_Grams] = []


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of `width` consecutive keys, from prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def runs_of(raw: np.ndarray, lengths: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and keys of the runs of texts that lie one behind the other."""
    if not _grams:
        _grams.append(_Grams())
    ends = np.cumsum(lengths)
    firsts, counts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s in range(0, len(raw) - WINDOW + 1, SEGMENT):
        part = raw[s : s + SEGMENT + WINDOW - 1]
        hashes = _grams[0](part, gram)
        ranked = (hashes & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(ranked, WINDOW - gram + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        border = np.zeros(len(part), np.int32)
        border[ends[(ends > s) & (ends < s + len(part))] - s] = 1
        text = np.cumsum(border)
        inside = np.flatnonzero(text[: len(anchor)] == text[WINDOW - 1 :])
        if not len(inside):
            continue
        anchor = anchor[inside]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1))
        first = np.flatnonzero(new)
        firsts.append(inside[first] + s)
        counts.append(np.diff(np.append(first, len(inside))))
        keys.append(hashes[anchor[first]])
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(keys).view(np.int64)


# --- packs ---------------------------------------------------------------


def _arrow(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def packs(texts: DataFrame, gram: int, id_type: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Rows (p, ids, lengths, weights, blob, first, count, keys, distinct, sums) of texts (id, data, w) of about `pack_bytes`."""
    import zstandard

    kind = pa.int64() if id_type == "long" else pa.binary()

    def row(held: list[tuple], number: int) -> pa.RecordBatch:
        ids, data, weights = zip(*held, strict=True)
        lengths, body = np.array([len(d) for d in data], np.int64), b"".join(data)
        first, count, keys = runs_of(np.frombuffer(body, np.uint8), lengths, gram)
        of = np.searchsorted(np.cumsum(lengths), first, side="right")
        distinct, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, np.array(weights, np.float64)[of], minlength=len(distinct)).astype(np.int64)
        listed = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
        return _arrow({
            "p": pa.array([(TaskContext.get().partitionId() << 24) + number]), "ids": listed(list(ids), kind), "lengths": listed(lengths), "weights": listed(list(weights)),
            "blob": pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary()), "first": listed(np.diff(first, prepend=0)), "count": listed(count),
            "keys": listed(keys), "distinct": listed(distinct), "sums": listed(sums),
        })

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for one in zip(*[batch.column(c).to_pylist() for c in ("id", "data", "w")], strict=True):
                held.append(one)
                size += len(one[1])
                if size >= pack_bytes:
                    yield row(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(held, number)

    lists = ", ".join(f"{c} array<long>" for c in ("lengths", "weights"))
    more = ", ".join(f"{c} array<long>" for c in ("first", "count", "keys", "distinct", "sums"))
    return texts.select("id", "data", F.col("w").cast("long").alias("w")).mapInArrow(make, f"p long, ids array<{id_type}>, {lists}, blob binary, {more}")


class Pack:
    def __init__(self, row: dict):
        import zstandard

        self.ids, self.lengths = row["ids"], np.array(row["lengths"], np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(row["blob"])
        self.first, self.count = np.cumsum(np.array(row["first"], np.int64)), np.array(row["count"], np.int64)

    def marks(self, answers: list[dict]) -> np.ndarray:
        """Whether each position starts a repeated window."""
        found = np.zeros(len(self.body), bool)
        for a in answers:
            bits = np.frombuffer(a["bits"], np.uint8)
            for i in a["at"]:
                found[self.first[i] : self.first[i] + self.count[i]] = np.unpackbits(bits, count=self.count[i])
        return found


def _runs(packed: pa.Table, hits: pa.Table) -> pa.Table:
    """The different runs of a pack whose keys occur twice, with their bytes and where in the pack they are."""
    out: dict[bytes, list] = {}
    keys = np.concatenate([np.zeros(0, np.int64), *[np.array(h, np.int64) for h in hits.column("hits").to_pylist()]])
    p = None
    for row in packed.to_pylist():
        pack, own, p = Pack(row), np.array(row["keys"], np.int64), row["p"]
        weights = np.array(row["weights"], np.int64)[np.searchsorted(np.cumsum(pack.lengths), pack.first, side="right")]
        for i in np.flatnonzero(np.isin(own, keys)).tolist():
            data = pack.body[pack.first[i] : pack.first[i] + pack.count[i] + WINDOW - 1]
            digest = hashlib.blake2b(data, digest_size=DIGEST).digest()
            known = out.setdefault(digest, [[], int(own[i]), 0, data])
            known[0].append(i)
            known[2] += int(weights[i])
    at, key, n, data = map(list, zip(*out.values(), strict=True)) if out else ([], [], [], [])
    columns = [pa.array([p] * len(out), pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(key, pa.int64()), pa.array(list(out), pa.binary()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
    return pa.table(columns, names=["p", "at", "key", "digest", "n", "data"])


# --- suffix arrays of runs ----------------------------------------------


def _repeated(strings: list[list[tuple[bytes, int, bytes]]]) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bits) of the runs (digest, number, bytes) of each string: which of their windows occur twice in it."""
    lengths = np.array([sum(len(d) + 1 for _, _, d in s) for s in strings])
    runs = [r for s in strings for r in s]
    sizes = np.array([len(d) for _, _, d in runs])
    # bytes are characters from 2 on, a 1 stands between runs and a 0 at the end of a string
    text = np.frombuffer(b"\0".join([d for _, _, d in runs]) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    after = np.cumsum(sizes + 1) - 1
    text[after] = 1
    text[np.cumsum(lengths) - 1] = 0
    array = suffixes.arrays(text, lengths)
    prefix = suffixes.permuted_prefixes(text, lengths, array, WINDOW)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    starts = after - sizes
    at = suffixes._spread(starts, windows)
    weight = np.zeros(len(text))
    weight[at] = np.repeat(np.array([n for _, n, _ in runs], np.float64), windows)
    group = np.cumsum(prefix[array] < WINDOW) - 1
    again = np.zeros(len(text), bool)
    again[array] = (np.bincount(group, weight[array]) >= 2)[group]
    for (digest, _, _), s, n in zip(runs, starts.tolist(), windows.tolist(), strict=True):
        yield digest, np.packbits(again[s : s + n]).tobytes()


def _solved(part: pd.DataFrame) -> pd.DataFrame:
    """Which windows of the runs of some keys are repeated."""
    by_key: dict[int, list] = {}
    for key, digest, n, data in zip(part["key"].tolist(), part["digest"], part["n"].tolist(), part["data"], strict=True):
        by_key.setdefault(key, []).append((digest, n, data))
    # a key's only run stands for two or more equal ones, so there is nothing to compare it with
    out = [(d, np.packbits(np.full(len(data) - WINDOW + 1, n >= 2)).tobytes()) for runs in by_key.values() if len(runs) == 1 for d, n, data in runs]
    strings = sorted((runs for runs in by_key.values() if len(runs) > 1), key=lambda runs: -sum(len(d) + 1 for _, _, d in runs))
    for s, e in suffixes.batches([sum(len(d) + 1 for _, _, d in runs) for runs in strings], BATCH):
        out += _repeated(strings[s:e])
    return pd.DataFrame(out, columns=["digest", "bits"])


# --- rounds --------------------------------------------------------------


def answers(packed: DataFrame, grams: tuple[int, ...] = GRAMS, string_bytes: int = STRING_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Rows (p, at, bits) for stored packs: the repeated windows of their runs `at`."""
    each = packed.select("p", F.explode(F.arrays_zip("distinct", "sums")).alias("k")).select("p", F.col("k.distinct").alias("key"), F.col("k.sums").alias("n"))
    twice = each.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    hits = each.join(twice, "key", "left_semi").groupBy(F.col("p").alias("of")).agg(F.collect_list("key").alias("hits"))
    texts = packed.drop("distinct", "sums")
    sent = common.store(texts.groupBy("p").cogroup(hits.groupBy("of")).applyInArrow(_runs, RUNS), "repeats-sent")
    runs = common.store(sent.groupBy("digest").agg(F.first("key").alias("key"), F.sum("n").alias("n"), F.first("data").alias("data")), "repeats-runs")
    solve, hot = runs, None
    if len(grams) > 1:
        size = runs.groupBy("key").agg(F.sum(F.length("data")).alias("size"), F.count("*").alias("m"))
        hot = common.store(size.filter((F.col("size") > string_bytes) & (F.col("m") > 1)).select("key"), "repeats-hot")
        if hot.isEmpty():
            hot = None
        else:
            solve = runs.join(hot, "key", "left_anti")
    total = runs.agg(F.sum(F.length("data"))).first()[0] or 0
    bucket = F.pmod("key", F.lit(max(1, -(-total // BUCKET_BYTES)))).alias("bucket")
    found = solve.select("*", bucket).groupBy("bucket").applyInPandas(_solved, ANSWER)
    if hot is not None:
        again = runs.join(hot, "key", "left_semi").select(F.col("digest").alias("id"), "data", F.col("n").alias("w"))
        below = common.store(packs(again, grams[1], "binary", pack_bytes), "repeats-pack")
        found = found.unionByName(marked(below, answers(below, grams[1:], string_bytes, pack_bytes)))
    found = common.store(found, "repeats-found")
    return sent.select("p", "at", "digest").join(found, "digest").select("p", "at", "bits")


def marked(packed: DataFrame, solved: DataFrame) -> DataFrame:
    """(digest, bits) of texts that are runs themselves: which of their windows are repeated."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out, found = [], right.to_pylist()
        for row in left.to_pylist():
            pack = Pack(row)
            marks, weights = pack.marks(found), row["weights"]
            ends = np.cumsum(pack.lengths)
            for digest, n, w, e in zip(pack.ids, pack.lengths.tolist(), weights, ends.tolist(), strict=True):
                windows = marks[e - n : e - WINDOW + 1]
                out.append((digest, np.packbits(windows if w < 2 else np.ones(len(windows), bool)).tobytes()))
        return pa.table([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["digest", "bits"])

    return packed.groupBy("p").cogroup(solved.groupBy("p")).applyInArrow(make, ANSWER)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removal(with_text: bool):
    """Rows of the documents of a pack."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found = [], right.to_pylist()
        for row in left.to_pylist():
            pack = Pack(row)
            starts = np.flatnonzero(pack.marks(found))
            edges = np.zeros(len(pack.body) + 1, np.int32)
            edges[starts] += 1
            edges[starts + WINDOW] -= 1
            covered = np.cumsum(edges)[:-1] > 0
            raw, e = np.frombuffer(pack.body, np.uint8), 0
            for doc_id, n in zip(pack.ids, pack.lengths.tolist(), strict=True):
                s, e = e, e + n
                gone = covered[s:e]
                removed, kept = int(gone.sum()), pack.body[s:e]
                spans = int((gone & ~np.append(False, gone[:-1])[:n]).sum()) if removed else 0
                if removed:
                    kept = raw[s:e][~gone].tobytes()
                rows.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return make


def removed(docs: DataFrame, with_text: bool = False, grams: tuple[int, ...] = GRAMS, string_bytes: int = STRING_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; the kept bytes if asked for."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"), F.lit(1).alias("w"))
    packed = common.store(packs(texts, grams[0], "long", pack_bytes), "repeats-pack")
    solved = answers(packed, grams, string_bytes, pack_bytes)
    light = packed.select("p", "ids", "lengths", "blob", "first", "count")
    out = light.groupBy("p").cogroup(solved.groupBy("p")).applyInArrow(_removal(with_text), RESULT)
    return out if with_text else out.drop("kept")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents; the module's defined cases hold."""
    return removed(common.documents(spark, sf_dir))


OP12_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, s, md5(substring(h, 2 * s + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hits AS MATERIALIZED (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM w SEMI JOIN twice USING (k)),
starts AS (SELECT r, s, p FROM hits WHERE p IS NULL OR s > p + 400),
spans AS (SELECT r, s AS b, coalesce(lead(p0) OVER (PARTITION BY r ORDER BY s), m) + 400 AS e
  FROM (SELECT starts.r, s, p AS p0, m FROM starts JOIN (SELECT r, max(s) AS m FROM hits GROUP BY r) USING (r))),
kept AS (SELECT r, string_agg(substring(h, 2 * f + 1, 2 * (b - f)), '' ORDER BY f) AS t FROM (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS f, b FROM (SELECT r, b, e FROM spans UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM d)) JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
