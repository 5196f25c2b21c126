"""Document fingerprints by winnowing.

The k-grams of a text's code points are hashed with a rolling hash, and of every
window of consecutive grams the smallest hash is selected, the rightmost of equals.
Any passage of at least WINDOW + GRAM - 1 = 31 code points that two texts share puts
one of its selected grams in both fingerprints; the positions are kept, so that a
match can be placed. A text of fewer grams than a window selects its smallest, and
one shorter than a gram hashes as one gram.

A document meets its successor by ranges. Spark's range partitioning deals the keys
(doc_id, hash of the text) alone to ranges of about RANGE_POINTS code points; the
least key of each is both the range's bound and its first document. Texts are then
shuffled once, to the range that holds their key, and the first of a range also to
the range before, where it follows the last. A range is read in order, text by text,
so its size is bounded by nothing but disk.

Defined cases: a null text is empty and has an empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0; the next document of the last
is the first, of a lone one itself; rows of equal doc_id follow each other by the
hash of their texts and then by text, null ids come last, and ranges part them like
others; rows equal in both are in one range, which winnows their text once; a very
long text is winnowed slice by slice; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM = 12
WINDOW = 20
#: A range has about this many code points, or this many documents if that makes more ranges.
RANGE_POINTS = 4_000_000
RANGE_ROWS = 20_000
#: Beyond so many ranges they grow instead, so the table of bounds that all tasks get stays under 2 MB.
MOST_RANGES = 1 << 16
#: Grams that are hashed at once, and code points of texts after which results are handed on.
SLICE = 1 << 18
BATCH_POINTS = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 15), base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of `gram` code points (one of all, if there are fewer), each from the last by running sums."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    gram = min(gram, n)
    values = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h >> np.uint64(32)


def _selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the windows' smallest hashes, the rightmost of equals, ascending."""
    n = len(hashes)
    # of equal hashes the later has the smaller key, so a minimum is the rightmost
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    if n <= window:
        least = keys.min(keepdims=True)
    else:
        # minima of windows from prefix and suffix minima of blocks as long as a window
        padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = keys
        blocks = padded.reshape(-1, window)
        prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(suffix[: n - window + 1], prefix[window - 1 : n])
        least = least[np.append(True, least[1:] != least[:-1])]
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    total = max(len(text) - gram + 1, min(len(text), 1))
    found, places, last = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], -1
    for s in range(0, max(total - window + 1, min(total, 1)), slice_):
        # the windows that start in a slice reach into the next
        points = np.frombuffer(text[s : s + slice_ + window + gram - 2].encode("utf-32-le"), np.uint32)
        hashes = gram_hashes(points, gram)
        at = _selected(hashes, window)
        at = at[at + s > last]
        if len(at):
            found.append(hashes[at].astype(np.uint32))
            places.append(at + s)
            last = int(at[-1]) + s
    return np.concatenate(found), np.concatenate(places)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: hash+distance from the last position (the first from 0), both in hexadecimal."""
    steps = np.diff(positions, prepend=0)
    return " ".join([f"{h:08x}+{d:x}" for h, d in zip(hashes.tolist(), steps.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of selected hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


class _Document:
    """A text with its fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.hashes, positions = winnow(text)
        self.written = written(self.hashes, positions)
        self.copied: tuple | None = None

    def beside(self, following: _Document) -> tuple:
        """What is said of this document, given the one that follows; the same for every copy that a copy follows."""
        if following is self and self.copied:
            return self.copied
        new = edited(self.text, following.text)
        hashes, positions = winnow(new)
        digest = hashlib.sha256(new.encode()).hexdigest()
        found = len(self.text), digest, self.written, written(hashes, positions), likeness(self.hashes, hashes), likeness(self.hashes, following.hashes)
        if following is self:
            self.copied = found
        return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of sorted (part, ahead, doc_id, text); those sent ahead only follow."""
    last, last_part, last_id, rows, held = None, None, None, [], 0
    for batch in batches:
        for at in range(len(batch)):  # text by text, so that few are held twice
            part, ahead, doc_id, text = (batch.column(c)[at].as_py() for c in range(4))
            if last is None or last_part != part:
                now = _Document(text)
            else:
                now = last if last.text == text else _Document(text)
                rows.append((last_id, *last.beside(now)))
                held += len(text)
            last, last_part, last_id = None if ahead else now, part, doc_id
            if held >= BATCH_POINTS:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _key() -> tuple[Column, ...]:
    """What documents are ordered by: the id, null last, and the hash of the text."""
    return F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")


def _bounds(chosen: DataFrame) -> DataFrame:
    """Rows (group, step, ranges, near): the least keys of all ranges but empty ones, in order, in groups of `step`.

    Only keys are shuffled, by Spark's range partitioning; there are MOST_RANGES of them at most.
    """
    size = chosen.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    ranges = min(max(1, -(-size[0] // RANGE_POINTS), -(-size[1] // RANGE_ROWS)), MOST_RANGES)
    step = max(1, round(ranges**0.5))
    keys = chosen.select(*_key()).repartitionByRange(ranges, "z", "i", "h")
    firsts = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("z", "i", "h")).alias("key"))
    ordered = firsts.agg(F.sort_array(F.collect_list("key")).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(step))
    groups = ordered.select(F.size("all").alias("ranges"), F.posexplode(F.transform(starts, lambda s: F.slice("all", s + 1, F.lit(step)))).alias("group", "near"))
    return common.store(groups.select("group", F.lit(step).alias("step"), "ranges", "near"), "winnow-bounds")


def _dealt(chosen: DataFrame) -> DataFrame:
    """Rows (part, ahead, z, i, h, text): every document in its range, a range's first one also ahead in the range before."""
    bounds = _bounds(chosen)
    tops = bounds.agg(F.sort_array(F.collect_list(F.get("near", F.lit(0)))).alias("tops"))
    key = F.struct("z", "i", "h")
    # a search in two steps, the group of bounds and then the bound; both tables are bounded by MOST_RANGES keys
    keyed = chosen.select(*_key(), "text").crossJoin(F.broadcast(tops))  # one row
    keyed = keyed.select("z", "i", "h", "text", (F.size(F.filter("tops", lambda b: b <= key)) - 1).alias("at"))
    keyed = keyed.join(F.broadcast(bounds), F.col("at") == F.col("group"))
    part = F.col("group") * F.col("step") + F.size(F.filter("near", lambda b: b <= key)) - 1
    keyed = keyed.select("z", "i", "h", "text", part.alias("part"), F.when(F.array_contains("near", key), F.pmod(part - 1, F.col("ranges"))).alias("before"))
    place = lambda c, ahead: F.struct(F.col(c).alias("part"), F.lit(ahead).alias("ahead"))
    places = F.when(F.col("before").isNull(), F.array(place("part", 0))).otherwise(F.array(place("part", 0), place("before", 1)))
    return keyed.select(F.explode(places).alias("p"), "z", "i", "h", "text").select("p.part", "p.ahead", "z", "i", "h", "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = _dealt(chosen).repartition("part").sortWithinPartitions("part", "ahead", "z", "i", "h", "text")
    return ordered.select("part", "ahead", "i", "text").mapInArrow(_pairs, RESULT)


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    return fingerprint_pairs(common.documents(spark, sf_dir))
