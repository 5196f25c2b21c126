"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

Words compare by the characters that they share in order, gaps allowed: each run of
three characters within SPAN counts DECAY for every character skipped, so letters
pulled apart by others and foreign endings keep most of the likeness; signs are left out. The
kernel of two sentences sums the sharpened likeness of their distinct words. Landmarks
are words of the training sample, those that favour toxic documents and clean ones
that look like them; Nyström features are the likenesses to them, made
orthogonal by the inverse root of the landmarks' own kernel matrix.

Training is on labelled sentences. Labels are of documents, so the sentences of a
toxic document begin as toxic and, fit after fit, only those stay so that the model
takes for toxic, or the document's likeliest one (multiple-instance learning).

As the kernel of sentences adds over words, so does the decision; a worker keeps the
value of words it has met. A document's score is that of its likeliest sentence,
raised by the next two where they speak for toxic too.

Defined cases: a null or empty text gets the score of one like no landmark, and a row
with an unknown id the score of its text; with labels of one kind only, or none, every
score is a constant below one half; a document labelled twice is toxic if any label
says so, and of several texts of one id the greatest trains; rows of equal texts tie
and get equal scores; a very long text is scored whole, sentence by sentence; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import slices

#: The sample has at most so many labelled documents, toxic and clean, those of the smallest hash, and of each kind as
#: many as fit into TRAINING_POINTS code points together. It is the same whatever the size of the corpus.
TOXIC_DOCS, CLEAN_DOCS = 1500, 3000
TRAINING_POINTS = 12_000_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 72, 24
#: A landmark is at least so many times likelier in toxic documents; one chosen lessens the need of its documents for others.
LEAST_ODDS = 4.0
FADE = 0.7
SPAN = 9
DECAY = 0.7
SHARPEN = 4
FLOOR = 0.5
ALPHABET = 32
#: Longer words are taken in pieces of this length, each overlapping the last by half.
PIECE = 24
CACHE_WORDS = 400_000
FITS = 4
WORDS_AT_ONCE = 20_000
RIDGE = 1e-3
SLACK = 1.0

SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n+")
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Letters(dict):
    """Code points to one-byte letter codes: a to z as 1 to 26, other letters as 27 to 31,
    and 0 for what is no letter."""

    def __missing__(self, point: int) -> int:
        c = SIGNS.get(chr(point), chr(point))
        if "a" <= c <= "z":
            code = ord(c) - 96
        else:
            code = 27 + point % 5 if c.isalpha() else 0
        self[point] = code
        return code


_letters = _Letters()


def spelled(word: str) -> str:
    """A word as its letter codes; what is no letter, and no sign for one, is left out."""
    return word.lower().translate(_letters).replace("\0", "")


def pieces_of(spellings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of PIECE letter codes, and the spelling each row is of."""
    rows, owner = [], []
    for i, codes in enumerate(spellings):
        raw = codes.encode("latin-1")
        for s in range(0, max(1, len(raw) - PIECE // 2), PIECE // 2):
            rows.append(raw[s : s + PIECE].ljust(PIECE, b"\0"))
            owner.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PIECE).astype(np.int32), np.array(owner, np.int64)


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of distances within SPAN: the features of all rows, 0 where there is none, and their weight."""
    length = int((codes.max(axis=0) > 0).sum()) if len(codes) else 0
    for d1 in range(1, SPAN - 1):
        for d2 in range(1, SPAN - d1):
            n = length - d1 - d2
            if n > 0:
                a, b, c = codes[:, :n], codes[:, d1 : d1 + n], codes[:, d1 + d2 : d1 + d2 + n]
                there = (a > 0) & (b > 0) & (c > 0)
                yield np.where(there, (a * ALPHABET + b) * ALPHABET + c, 0), DECAY ** (d1 + d2 - 2)


def _by_length(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of rows of like length, so that short words do no work of long ones."""
    lengths = np.where(codes > 0, np.arange(1, codes.shape[1] + 1), 0).max(axis=1, initial=0)
    for low, high in ((2, 5), (5, 7), (7, 9), (9, 12), (12, 16), (16, PIECE)):
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        yield from np.array_split(at, -(-len(at) // 4000)) if len(at) else ()


def feature_table(codes: np.ndarray) -> np.ndarray:
    """Weighted triple counts of a few words, one column each, of norm 1; feature 0 stays 0."""
    table = np.zeros((ALPHABET**3, len(codes)), np.float32)
    for feature, weight in _triples(codes):
        row, col = np.nonzero(feature)
        np.add.at(table, (feature[row, col], row), weight)
    return table / np.maximum(np.sqrt((table**2).sum(axis=0)), 1e-9)


def _norms(found: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Norms of rows, features that occur again added up first."""
    features = np.concatenate([f for f, _ in found], axis=1)
    weights = np.concatenate([np.full(f.shape[1], w, np.float32) for f, w in found])
    order = np.argsort(features, axis=1)
    features, weights = np.take_along_axis(features, order, axis=1), weights[order]
    weights[features == 0] = 0
    new = np.ones(features.shape, bool)
    new[:, 1:] = features[:, 1:] != features[:, :-1]
    starts = np.flatnonzero(new)
    squares = np.add.reduceat(weights.ravel(), starts) ** 2
    return np.sqrt(np.maximum(np.bincount(starts // features.shape[1], squares, len(features)), 1e-12))


def likeness(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sharpened likeness of each row to each landmark of `table`.

    Likeness below FLOOR counts as none. The largest entry of each feature over all
    landmarks bounds every likeness of a row, as does a norm that leaves features that
    occur again apart; rows bounded below FLOOR, nearly all, need no more work.
    """
    out = np.zeros((len(codes), table.shape[1]), np.float32)
    most = table.max(axis=1)
    for at in _by_length(codes):
        bound, square = np.zeros(len(at), np.float32), np.full(len(at), 1e-12, np.float32)
        for feature, weight in _triples(codes[at]):
            bound += weight * most[feature].sum(axis=1)
            square += weight * weight * (feature > 0).sum(axis=1)
        norm = np.sqrt(square)
        some = bound >= FLOOR * norm
        if some.any():
            found = list(_triples(codes[at[some]]))
            sums = np.zeros((int(some.sum()), table.shape[1]), np.float32)
            for feature, weight in found:
                sums += weight * table[feature].sum(axis=1)
            like = np.minimum(sums / _norms(found)[:, None], 1.0)
            out[at[some]] = np.where(like >= FLOOR, like, 0.0) ** SHARPEN
    return out


@dataclass
class Model:
    table: np.ndarray
    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_values(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's decision; of a long word, its likeliest piece."""
        spellings = [spelled(w) for w in words]
        place = {w: i for i, w in enumerate(dict.fromkeys(spellings))}
        codes, owner = pieces_of(list(place))
        out = np.full(len(place), -np.inf)
        np.maximum.at(out, owner, likeness(codes, self.table) @ self.beta)
        return out[[place[w] for w in spellings]]

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -50, 50)))


def sentences(text: str) -> list[list[str]]:
    """Distinct words of each sentence; letters that stand alone in a row are also one word."""
    out = []
    for sentence in SENTENCE.split(text):
        words = sentence.split()
        if not words:
            continue
        if list(map(len, words)).count(1) >= 4:
            run: list[str] = []
            for w in [*words, "  "]:
                if len(w) == 1:
                    run.append(w)
                else:
                    if len(run) >= 4:
                        words.append("".join(run))
                    run = []
        out.append(list(dict.fromkeys(words)))
    return out


def _svm(z: np.ndarray, like: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps on its active set.

    `z` has the rows of the sentences marked in `like`; those of all others are zero.
    """
    # sentences without any likeness are one row a label, of their joint weight;
    # and what is like no landmark, an empty text for one, counts as clean
    joint = [(label, weight[~like & (y == label)].sum() + (y < 0).sum() * (label < 0)) for label in (-1.0, 1.0)]
    joint = [(label, total) for label, total in joint if total > 0]
    x = np.column_stack([np.vstack([z, np.zeros((len(joint), z.shape[1]))]), np.ones(len(z) + len(joint))])
    y = np.append(y[like], [label for label, _ in joint])
    weight = np.append(weight[like], [total for _, total in joint])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for step in range(25):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + SLACK * xa.T @ x[active], SLACK * xa.T @ y[active])
        if np.abs(new - w).max() < 1e-5:
            break
        w = 0.5 * w + 0.5 * new if step > 8 else new
    return w


def _platt(decision: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve of decisions, by Newton steps."""
    x, w = np.column_stack([decision, np.ones(len(decision))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-3]), x.T @ (p - y) + np.array([1e-2 * (w[0] - 1), 1e-3 * w[1]]))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def choose_landmarks(docs: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Words that favour toxic documents, each chosen for those that hold few chosen so far; then clean words like them.

    The clean ones are those that a likeness alone would mistake, such as the stem of
    an insult that is a plain word by itself.
    """
    inside, outside = Counter(), Counter()
    for words, t in zip(docs, toxic.tolist(), strict=True):
        (inside if t else outside).update(words)
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    odds = {w: (c + 0.5) / (n1 + 1) * (n0 + 1) / (outside[w] + 0.5) for w, c in inside.items() if c >= 2 and len(spelled(w)) >= 3}
    holders: dict[str, list[int]] = {w: [] for w, r in odds.items() if r >= LEAST_ODDS}
    for i in np.flatnonzero(toxic).tolist():
        for w in docs[i]:
            if w in holders:
                holders[w].append(i)
    need, best = np.ones(len(docs)), []
    while holders and len(best) < TOXIC_LANDMARKS:
        word = max(holders, key=lambda w: (np.sqrt(need[holders[w]].sum()) * np.log(odds[w]), w))
        need[holders.pop(word)] *= FADE
        best.append(word)
    if not best:
        return []
    others = sorted(w for w, c in outside.items() if c >= 2 and odds.get(w, 0) < 1 and len(spelled(w)) >= 3)
    codes, owner = pieces_of([spelled(w) for w in others])
    like = np.zeros(len(others))
    np.maximum.at(like, owner, likeness(codes, feature_table(_all_pieces(best))).max(axis=1, initial=0))
    mistaken = sorted((i for i in range(len(others)) if like[i] > 0), key=lambda i: (-like[i] * np.sqrt(outside[others[i]]), others[i]))
    return best + [others[i] for i in mistaken[:CLEAN_LANDMARKS]]


def _all_pieces(words: list[str]) -> np.ndarray:
    return pieces_of([spelled(w) for w in words])[0]


def bare(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]|*%$&#")


def document_value(sums: list[float]) -> float:
    """The value of a document: that of its likeliest sentence, and half and a quarter of the next two, where they speak for toxic."""
    first = nlargest(3, sums)
    return first[0] + sum(max(v, 0.0) / 2**i for i, v in enumerate(first[1:], 1)) if first else 0.0


def nothing_learned() -> Model:
    """A constant score below one half."""
    return Model(np.zeros((ALPHABET**3, 1), np.float32), np.zeros(1), 0.0, 1.0, -3.0)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on texts and their labels 0 and 1."""
    order = {}
    for i, t in enumerate(texts):  # a text that repeats has one vote
        order.setdefault(t, i)
    keep = np.array(sorted(order.values()), np.int64)
    texts, toxic = [texts[i] for i in keep.tolist()], labels[keep].astype(bool) if len(keep) else np.zeros(0, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return nothing_learned()
    same: dict[str, str] = {}  # a word that repeats is held once
    split = [[[same.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    landmarks = choose_landmarks([{bare(w) for s in doc for w in s} for doc in split], toxic)
    if not landmarks:
        return nothing_learned()
    codes = _all_pieces(landmarks)
    table = feature_table(codes)
    values, vectors = np.linalg.eigh(likeness(codes, table).astype(float) + RIDGE * np.eye(len(codes)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, RIDGE))) @ vectors.T
    # likenesses of the few words that have any, by number; number 0 is for all others
    number, rows = dict.fromkeys({w for doc in split for s in doc for w in s}, 0), [np.zeros((1, len(codes)), np.float32)]
    for at in range(0, len(number), WORDS_AT_ONCE):
        words = list(islice(number, at, at + WORDS_AT_ONCE))
        pieces, owner = pieces_of([spelled(w) for w in words])
        by_word = np.zeros((len(words), len(codes)), np.float32)
        np.maximum.at(by_word, owner, likeness(pieces, table))
        for i in np.flatnonzero(by_word.any(axis=1)).tolist():
            number[words[i]] = len(rows)
            rows.append(by_word[i : i + 1])
    by_word = np.vstack(rows)
    flat = [[k for w in s if (k := number[w])] for doc in split for s in doc]
    doc_of = np.repeat(np.arange(len(split)), [len(doc) for doc in split])
    like = np.array([bool(s) for s in flat], bool)
    features = np.vstack([np.zeros((0, len(codes))), *[by_word[s].sum(axis=0)[None] for s in flat if s]]) @ root

    def decided(w: np.ndarray) -> np.ndarray:
        out = np.full(len(flat), w[-1])
        out[like] += features @ w[:-1]
        return out

    y = np.where(toxic[doc_of], 1.0, -1.0)
    for _ in range(FITS):
        balance = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
        w = _svm(features, like, y, np.sqrt(balance / balance.min()))
        decision = decided(w)
        best = np.full(len(split), -np.inf)
        np.maximum.at(best, doc_of, decision)
        stays = toxic[doc_of] & ((decision > 0) | (decision == best[doc_of]))
        # sentences that fell out of a toxic document say nothing either way
        used = stays | ~toxic[doc_of]
        y = np.where(stays, 1.0, -1.0)[used]
        weight = np.where(y > 0, np.sqrt((y < 0).sum() / max((y > 0).sum(), 1)), 1.0)
        w = _svm(features[used[like]], like[used], y, weight)
        decision = decided(w)
        best = np.full(len(split), -np.inf)
        np.maximum.at(best, doc_of, decision)
        y = np.where(toxic[doc_of] & ((decision > 0) | (decision == best[doc_of])), 1.0, -1.0)
    sums = (decision - w[-1]).tolist()
    ends = np.cumsum([len(doc) for doc in split]).tolist()
    worst = np.array([document_value(sums[e - len(doc) : e]) for e, doc in zip(ends, split, strict=True)])
    slope, shift = _platt(worst + w[-1], toxic.astype(float))
    return Model(table, root @ w[:-1], float(w[-1]), slope, shift)


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """The bounded training sample, none of it held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~common.held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    kind = lambda v, most: one.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = kind(1, TOXIC_DOCS).unionByName(kind(0, CLEAN_DOCS))  # bounded, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select(F.xxhash64("doc_id").alias("rank"), "doc_id", "y", F.length("text").alias("points"), "text")
    texts = common.store(texts, "toxic-sample")
    chosen, room = [], {0: TRAINING_POINTS, 1: TRAINING_POINTS}
    for r in sorted(texts.select("rank", "doc_id", "y", "points").collect()):
        if r.points <= room[r.y]:
            room[r.y] -= r.points
            chosen.append(r.doc_id)
    got = sorted(texts.filter(F.col("doc_id").isin(chosen)).select("rank", "doc_id", "text", "y").collect())
    return [r.text for r in got], np.array([r.y for r in got])


_values: dict = {}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    key = uuid.uuid4().hex  # a worker that meets another model forgets its words

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        if _values.get("model") != key:
            _values.clear()
            _values.update(model=key, words={})
        known, out = _values["words"], []
        for _, run in slices(texts):
            split = [sentences(t) for t in run]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list({w for doc in split for s in doc for w in s}.difference(known))
            known.update(zip(new, m.word_values(new).tolist() if new else (), strict=True))
            get = known.__getitem__
            out += [document_value([sum(map(get, s)) for s in doc]) for doc in split]
        return pd.Series(m.probability(np.array(out, float) + m.bias))

    got = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document.

    Reads doc_id and text of the whole table, and the labels that are not held out;
    the module's defined cases hold.
    """
    docs = common.documents(spark, sf_dir)
    return scored(docs, fit(*training_texts(docs, common.labels(spark, sf_dir))))
