"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

A document is its token ids and an end id; one longer than a sequence is cut into
full pieces and a rest. Pieces are dealt by hash to partitions of about PART_ROWS
and each partition packs its own by best-fit decreasing. Dual feasible functions
give a lower bound on the number of sequences that any packing of a partition needs.
A partition that meets its bound is certified and settled. One with a gap settles
its full sequences and gives the pieces of all others up; the pieces so given up by
all partitions are dealt anew and packed again, for a few rounds.

Only piece lengths and checksums are shuffled, never texts or ids.

Defined cases: a null text is empty and packs its end id alone; a text that holds the
name of a special token of the vocabulary gets that token's id there, as the plain
tokenizer has it; a very long text is cut into pieces as it is encoded; equal rows are
separate documents; ids may repeat or be null, as pieces are dealt by row and not by
id; of pieces of equal length that come first which are read first; an empty table
packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
PART_ROWS = 20_000
ROUNDS = 4
#: A worker's cache of word ids is emptied beyond this many words, and texts are taken in slices of this many bytes.
CACHE_WORDS = 800_000
SLICE_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"row long, {PIECES}, sequence_id long, offset long, settled boolean"


class WordIds:
    """Token ids of a text, word by word, as little-endian 32-bit numbers.

    White space parts tokens and is dropped in this vocabulary, so a text's ids are
    those of its words one after the other. Words repeat, so their ids are kept. New
    words of plain letters share their parts, runs of letters, digits or signs, and
    new parts are encoded many at a time, which ids that end a part divide again; all
    other words are encoded as they are. Case is dropped, from ASCII texts at once.
    """

    #: Words of these characters are parted here just as the tokenizer does.
    PLAIN = re.compile(r"[!-~ß-öø-ÿÀ-ÖØ-Þ]+")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same merges for parts that are in lower case and parted already
        self.merges = Tokenizer.from_file(vocabulary)
        self.merges.encode_special_tokens = True
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encoded(self, texts: list[str], special: bool) -> list[bytes]:
        """Ids of texts; without `special` the names of special tokens are plain text, as lower case and splitting may make a word look like one."""
        self.tokenizer.encode_special_tokens = not special
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, new: list[str]) -> None:
        runs = [" ".join(new[i : i + 200]) for i in range(0, len(new), 200)]
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in self.merges.encode_batch_fast(runs, add_special_tokens=False)])
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) == len(new):
            raw = ids.tobytes()
            self.parts.update(zip(new, (raw[s:e] for s, e in pairwise([0, *ends.tolist()])), strict=True))
        else:
            self.parts.update(zip(new, self._encoded(new, False), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        # letters alone are one part; all else is parted by the pattern
        alone = [w for w in new if w.isalpha()]
        lower = [w.lower().decode() for w in alone]
        several, parted, other = [], [], []
        for word in new:
            if word.isalpha():
                continue
            text = word.decode()
            if self.PLAIN.fullmatch(text):
                several.append(word)
                parted.append(self.PART.findall(text.lower()))
            else:
                other.append(word)
        if other:
            self.known.update(zip(other, self._encoded([w.decode() for w in other], False), strict=True))
        if fresh := list(set(lower).union(*parted).difference(self.parts)):
            self._learn_parts(fresh)
        get = self.parts.__getitem__
        self.known.update(zip(alone, map(get, lower), strict=True))
        self.known.update(zip(several, (b"".join(map(get, p)) for p in parted), strict=True))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. One with a special token is no sequence of words, and goes to the tokenizer whole."""
        plain = [not any(s in t for s in self.special) for t in texts]
        of_words = self._of_words(list(compress(texts, plain)))
        return (next(of_words) if p else self._encoded([t], True)[0] for t, p in zip(texts, plain, strict=True))

    def _of_words(self, texts: list[str]) -> Iterator[bytes]:
        words = [(t.encode().lower() if t.isascii() else t.encode()).split() for t in texts]
        flat = list(chain.from_iterable(words))
        if len(self.known) > CACHE_WORDS:  # what shows up again now is likely to do so again
            self.known = {w: self.known[w] for w in set(flat).intersection(self.known)}
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        ids = list(map(self.known.get, flat))
        if unknown := [i for i, x in enumerate(ids) if x is None]:
            self._learn(list({flat[i] for i in unknown}))
            for i in unknown:
                ids[i] = self.known[flat[i]]
        ends = accumulate(map(len, words))
        return (b"".join(ids[end - len(w) : end]) for w, end in zip(words, ends, strict=True))


_word_ids: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """This worker's tokenizer for a vocabulary file."""
    if vocabulary not in _word_ids:
        _word_ids[vocabulary] = WordIds(vocabulary)
    return _word_ids[vocabulary]


def slices(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE_BYTES characters, each with its first position."""
    start, run, held = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text)
        held += len(text)
        if held >= SLICE_BYTES:
            yield start, run
            start, run, held = i + 1, [], 0
    if run:
        yield start, run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    `vocabulary` is a tokenizer file that is there on every executor.
    """
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(vocabulary or default_vocabulary())
        for batch in batches:
            doc_ids = batch["doc_id"].tolist()
            for at, texts in slices(batch["text"]):
                rows = []
                for doc_id, ids in zip(doc_ids[at : at + len(texts)], ids_of.of(texts), strict=True):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[i : i + 4 * capacity]
                        rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest sequences that can hold pieces of these lengths, by dual feasible functions.

    A dual feasible function maps lengths to weights so that what fits a sequence
    weighs 1 at most; the total weight bounds the number of sequences. Two families:
    for a cut a, lengths above capacity - a count as whole sequences and those below a
    as nothing; for a number k, lengths are rounded to multiples of 1 / (k + 1), down
    where they are not such multiples and scaled by (k + 1) / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    at_least = np.cumsum((count * size)[::-1])[::-1]
    larger = np.cumsum(count[::-1])[::-1]
    cuts = np.arange(1, capacity // 2 + 1)
    whole = np.where(capacity - cuts + 1 <= capacity, larger[np.minimum(capacity - cuts + 1, capacity)], 0)
    between = at_least[cuts] - at_least[np.minimum(capacity - cuts + 1, capacity)]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int(count @ weight) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each length, and each bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    rooms = 0  # bit r is set where a bin has room r
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += length
        if room > length:
            with_room[room - length].append(b)
            rooms |= 1 << (room - length)
    return bins, offsets, np.asarray(fill, np.int64)


def _pack_round(items: DataFrame, number: int, capacity: int, last: bool) -> DataFrame:
    parts = max(1, -(-items.count() // PART_ROWS))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="part")
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == lower_bound(lengths, capacity)
        settled = np.full(len(part), True) if certified or last else fill[bins] == capacity
        return part.assign(sequence_id=(number << 58) + (int(key[0]) << 22) + bins, offset=offsets, settled=settled)

    dealt = items.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, PLACED)


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # the row's number is stored with it, so it is the same whenever it is read
    cut = pieces(docs, vocabulary, capacity).select(F.monotonically_increasing_id().alias("row"), "*")
    left, done = common.store(cut, "pack-piece"), None
    for number in range(rounds):
        last = number == rounds - 1
        out = common.store(_pack_round(left, number, capacity, last), f"pack-{number}")
        settled = out.filter("settled").drop("row", "settled")
        done = settled if done is None else done.unionByName(settled)
        left = out.filter("not settled").drop("sequence_id", "offset", "settled")
        if last or left.isEmpty():
            break
    return done


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    return packed(common.documents(spark, sf_dir))
