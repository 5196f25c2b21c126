"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words of a document. Every word covered by a window
whose words also start earlier (in a smaller doc_id, or earlier in the document) is
removed, windows being judged on the input.

Texts go once into packs, compressed tables of a few megabytes that task after task
reads where it is; only sketches, keys and bitmaps are shuffled.

1. Each pack makes a count-min sketch of its windows: ROWS rows of counters, of which
   a window raises one each. A row is cut into blocks of 2**CELL_BITS counters, as many
   as give each about 2**CELL_BITS / CELLS windows of the whole input, so errors stay
   the same at any size. Packs send the counters that they touch, each once with its
   count; a block's sketch is the sum of all packs' parts, an array of fixed size. A
   window's estimate is its least counter, never below its count, so windows estimated
   once are never repeated. The answer to a pack is one bit a counter: 2 or more.
2. Windows estimated repeated are grouped exactly, by the BLAKE2b digest of their
   words. A pack sends the first place of each of its digests to the digest's block;
   the answer is one bit a digest: these words start earlier elsewhere.
3. Each pack marks the covered words of its documents.

The hash that places a window in the sketch may collide, even by design, which costs
time alone; what is removed hangs on the digests of the words themselves.

A window that occurs in a third of all documents is one entry a pack, in the sketch
and in the exact pass, so no block grows with the copies of a text.

Defined cases: a null text has no words; with fewer words than a window nothing is
removed; rows of equal doc_id are copies of a document at the same place, neither
earlier; null ids come last; a very long text is whole in its pack; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
PACK_BYTES = 4_000_000
#: A row of the sketch has about CELLS counters a window, in blocks of 2**CELL_BITS.
ROWS = 2
CELLS = 8
CELL_BITS = 23
#: A block of digests has about this many windows that are estimated repeated, or fewer.
BLOCK_BITS = 20
DIGEST = 16
SEGMENT = 1_000_000
NO_ID = np.iinfo(np.int64).max

ANSWER = "p long, kind int, block long, bits binary"
EXACT = ROWS  # the kind of answers of the exact pass; those of the sketch have their row's number
U = np.uint64


# --- packs ---------------------------------------------------------------


def packs(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Rows (p, windows, blob): ids and words of documents of about `pack_bytes`."""
    import zstandard

    def rows(ids: list, texts: list[bytes], number: int, window: int = WINDOW) -> pd.DataFrame:
        lengths = np.array([len(t) for t in texts], np.int64)
        words = np.array([t.count(b" ") + bool(t) for t in texts])
        key = np.array([NO_ID if i is None or pd.isna(i) else int(i) for i in ids], np.int64)
        none = np.array([i is None or pd.isna(i) for i in ids], np.uint8)
        body = b"".join([len(ids).to_bytes(8, "little"), key.tobytes(), none.tobytes(), lengths.tobytes(), *texts])
        blob = zstandard.ZstdCompressor(level=1).compress(body)
        place = (TaskContext.get().partitionId() << 24) + number
        return pd.DataFrame({"p": [place], "windows": [int(np.maximum(words - window + 1, 0).sum())], "blob": [blob]})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held, number = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(doc_id)
                texts.append(b" ".join(text.encode().split()))
                held += len(texts[-1])
                if held >= pack_bytes:
                    yield rows(ids, texts, number)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield rows(ids, texts, number)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.mapInPandas(make, "p long, windows long, blob binary")


class Pack:
    """Documents of a pack: ids, whether an id is null, and words joined by spaces."""

    def __init__(self, blob: bytes):
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(body[:8], "little")
        self.ids = np.frombuffer(body, np.int64, n, 8)
        self.none = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(bool)
        lengths = np.frombuffer(body, np.int64, n, 8 + 9 * n)
        ends = 8 + 17 * n + np.cumsum(lengths)
        self.texts = [body[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
        self.words = np.array([t.count(b" ") + bool(t) for t in self.texts], np.int64)


# --- hashes ---------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of byte and word ranges, from running sums; for the sketch alone."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        bases = [int(b) | 1 for b in rng.integers(1 << 40, 1 << 62, 2)]
        self.bases = [(b, pow(b, -1, 1 << 64)) for b in bases]
        self.powers: list = [None, None]

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.powers[which] is None or len(self.powers[which][0]) < n:
            size = max(n, 1 << 16)
            made = []
            for base in self.bases[which]:
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.powers[which] = tuple(made)
        up, down = self.powers[which]
        return up[:n], down[:n]

    def _ranges(self, which: int, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(which, len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up, out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix(self._ranges(0, self.of_byte[raw], starts, ends) + (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, window: int) -> np.ndarray:
        starts = np.arange(len(words) - window + 1)
        return _mix(self._ranges(1, words, starts, starts + window))


_rolling: list[Rolling] = []


def window_hashes(pack: Pack, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of every document, and its first word's position in the pack."""
    if not _rolling:
        _rolling.append(Rolling(11))
    hashed, run, held = [np.zeros(0, np.uint64)], [], 0

    def flush() -> None:
        raw = np.frombuffer(b" ".join([*run, b""]), np.uint8)
        ends = np.flatnonzero(raw == 32)
        starts = np.append(0, ends[:-1] + 1)
        some = ends > starts
        hashed.append(_rolling[0].words(raw, starts[some], ends[some]))
        run.clear()

    for text in pack.texts:
        run.append(text)
        held += len(text)
        if held >= SEGMENT:
            flush()
            held = 0
    if run:
        flush()
    words = np.concatenate(hashed)
    doc = np.repeat(np.arange(len(pack.words)), pack.words)
    if len(doc) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    return _rolling[0].windows(words, window)[at], at


def window_digests(pack: Pack, doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of windows, in two halves; the windows are in order of their document's place in the pack."""
    out = []
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    for s, e in pairwise([*edges.tolist(), len(doc)]):
        text = pack.texts[doc[s]]
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        firsts, lasts = np.append(0, spaces + 1)[start[s:e]], np.append(spaces, len(text))[start[s:e] + window - 1]
        out += [hashlib.blake2b(text[i:j], digest_size=DIGEST).digest() for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True)]
    both = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


# --- messages ------------------------------------------------------------


def _planes(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, as high bytes are often zero and compress away."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in map(np.ascontiguousarray, columns))


def _unplaned(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel())
        at += n * width
    return out


def _blocks(codes: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(block, first, end) of sorted codes; a block is what is left of `shift` bits."""
    if not len(codes):
        return
    block = codes >> U(shift) if shift < 64 else np.zeros(len(codes), np.uint64)
    starts = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
        yield int(block[s]), s, e


class Counters:
    """The counters of a row of the sketch that a pack's windows touch: sorted codes (block and cell), their counts, and each window's counter."""

    def __init__(self, hashes: np.ndarray, row: int, bits: int, cell_bits: int):
        codes = _mix(hashes + U((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - cell_bits - bits)
        order = np.argsort(codes)
        ranked = codes[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        self.codes = ranked[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(ranked)))
        self.of = np.empty(len(codes), np.int64)
        self.of[order] = np.cumsum(new) - 1


def _sketch_parts(bits: int, cell_bits: int):
    """Messages of a pack: for each row and block the counters that it touches, as differences, and which it raises more than once."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, blob in zip(batch["p"].tolist(), batch["blob"], strict=True):
                hashes, rows = window_hashes(Pack(blob))[0], []
                for row in range(ROWS):
                    c = Counters(hashes, row, bits, cell_bits)
                    for block, s, e in _blocks(c.codes, cell_bits):
                        cells = (c.codes[s:e] & U((1 << cell_bits) - 1)).astype(np.uint32)
                        part = _planes(np.diff(cells, prepend=np.uint32(0))) + np.packbits(c.counts[s:e] > 1).tobytes()
                        rows.append((p, row, block, e - s, part))
                yield pd.DataFrame(rows, columns=["p", "row", "block", "n", "blob"])

    return make


def _merge_sketch(cell_bits: int):
    """Add up the packs' parts of a block; answer each pack which of its counters come to 2 or more."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        sketch = np.zeros(1 << cell_bits, np.uint8)
        cells = lambda b, n: np.cumsum(_unplaned(b, n, "u4")[0], dtype=np.uint32)
        messages = list(zip(part["blob"], part["n"].tolist(), strict=True))
        for blob, n in messages:
            at = cells(blob, n)
            more = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 4 * n), count=n)
            sketch[at] = np.minimum(sketch[at] + more + 1, 2)
        bits = [np.packbits(sketch[cells(blob, n)] > 1).tobytes() for blob, n in messages]
        return pd.DataFrame({"p": part["p"], "kind": part["row"], "block": part["block"], "bits": bits})

    return merge


class Marked:
    """Windows of a pack that are estimated repeated, in order of (digest, doc_id, start)."""

    def __init__(self, pack: Pack, answers: pd.DataFrame, bits: int, cell_bits: int):
        hashes, at = window_hashes(pack)
        hit = np.ones(len(hashes), bool)
        for row in range(ROWS):
            c = Counters(hashes, row, bits, cell_bits)
            mine = answers[answers["kind"] == row]
            by_block = dict(zip(mine["block"].tolist(), mine["bits"], strict=True))
            again = [np.unpackbits(np.frombuffer(by_block[b], np.uint8), count=e - s) for b, s, e in _blocks(c.codes, cell_bits)]
            if again:
                hit &= np.concatenate(again).astype(bool)[c.of]
        at = at[hit]
        doc_start = np.concatenate(([0], np.cumsum(pack.words)[:-1])) if len(pack.words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(pack.words)), pack.words)[at]
        ids, start = pack.ids[doc], at - doc_start[doc]
        high, low = window_digests(pack, doc, start)
        order = np.lexsort((start, ids, low, high))
        self.high, self.low, self.ids, self.start, self.at = (x[order] for x in (high, low, ids, start, at))
        self.lead = _leads(self.high, self.low)


def _leads(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where a new digest begins in sorted ones."""
    lead = np.ones(len(high), bool)
    lead[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return lead


def _exact_parts(bits: int, cell_bits: int, blocks: int):
    """Messages of a pack: for each block of digests, each digest's first place in the pack."""

    def make(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p, blob in zip(packed["p"].tolist(), packed["blob"], strict=True):
            m = Marked(Pack(blob), answers, bits, cell_bits)
            columns = [x[m.lead] for x in (m.high, m.low, m.ids)] + [m.start[m.lead].astype(np.uint32)]
            for block, s, e in _blocks(columns[0], 64 - blocks):
                rows.append((p, block, e - s, _planes(*(c[s:e] for c in columns))))
        return pd.DataFrame(rows, columns=["p", "block", "n", "blob"])

    return make


def _merge_exact(part: pd.DataFrame) -> pd.DataFrame:
    """Find each digest's first place; answer each pack which of its digests start earlier elsewhere."""
    counts = part["n"].to_numpy()
    columns = zip(*(_unplaned(b, n, "u8", "u8", "i8", "u4") for b, n in zip(part["blob"], counts.tolist(), strict=True)), strict=True)
    high, low, ids, start = map(np.concatenate, columns)
    order = np.lexsort((start, ids, low, high))
    lead = _leads(high[order], low[order])
    head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = (ids[order] != ids[head]) | (start[order] != start[head])
    bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(counts)[:-1])]
    return pd.DataFrame({"p": part["p"], "kind": np.int32(EXACT), "block": part["block"], "bits": bits})


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _removal(bits: int, cell_bits: int, blocks: int, with_text: bool):
    """Rows of the documents of a pack, from both kinds of answers."""

    def make(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for blob in packed["blob"]:
            pack = Pack(blob)
            m = Marked(pack, answers, bits, cell_bits)
            exact = answers[answers["kind"] == EXACT]
            by_block = dict(zip(exact["block"].tolist(), exact["bits"], strict=True))
            later = [np.unpackbits(np.frombuffer(by_block[b], np.uint8), count=e - s).astype(bool) for b, s, e in _blocks(m.high[m.lead], 64 - blocks)]
            key = np.cumsum(m.lead) - 1
            lead_at = np.flatnonzero(m.lead)[key] if len(key) else key
            gone = (m.ids != m.ids[lead_at]) | (m.start != m.start[lead_at])
            if later:
                gone |= np.concatenate(later)[key]
            total = int(pack.words.sum())
            edges = np.zeros(total + 1, np.int64)
            np.add.at(edges, m.at[gone], 1)
            np.add.at(edges, m.at[gone] + WINDOW, -1)
            covered = np.cumsum(edges)[:total] > 0
            ends = np.cumsum(pack.words)
            for doc_id, none, text, words, end in zip(pack.ids.tolist(), pack.none.tolist(), pack.texts, pack.words.tolist(), ends.tolist(), strict=True):
                cover = covered[end - words : end]
                removed = int(cover.sum())
                kept = b" ".join(compress(text.split(b" "), ~cover)) if removed else text
                rows.append((None if none else doc_id, words, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"doc_id": "Int64"})

    return make


def deduped(docs: DataFrame, with_text: bool = False, pack_bytes: int = PACK_BYTES, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; kept_text if asked for."""
    packed = common.store(packs(docs, pack_bytes), "substring-pack")
    windows = packed.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    bits = max(0, (max(windows, 1) * CELLS - 1).bit_length() - cell_bits)
    blocks = max(0, (max(windows, 1) - 1).bit_length() - BLOCK_BITS)
    texts = packed.select("p", "blob")
    counters = texts.mapInPandas(_sketch_parts(bits, cell_bits), "p long, row int, block long, n int, blob binary")
    repeated = common.store(counters.groupBy("row", "block").applyInPandas(_merge_sketch(cell_bits), ANSWER), "substring-repeated")
    keys = texts.groupBy("p").cogroup(repeated.groupBy("p")).applyInPandas(_exact_parts(bits, cell_bits, blocks), "p long, block long, n int, blob binary")
    later = common.store(keys.groupBy("block").applyInPandas(_merge_exact, ANSWER), "substring-later")
    answers = repeated.unionByName(later)
    out = texts.groupBy("p").cogroup(answers.groupBy("p")).applyInPandas(_removal(bits, cell_bits, blocks, with_text), RESULT)
    return out if with_text else out.drop("kept_text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    return deduped(common.documents(spark, sf_dir))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w),
keyed AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM win),
gone AS (SELECT doc_id, s FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
gaps AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(s, s + 20)) AS pos FROM gone)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gaps USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
