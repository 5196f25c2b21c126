"""Suffix arrays by induced sorting, of many short strings side by side.

Induced sorting reads a suffix array from one end to the other, each entry placing the
suffix before it, so its steps follow each other. Here thousands of independent
strings take a step at once: entry j of every string that has one is a single numpy
operation. Strings lie one behind the other in flat arrays, the longest first, so those
that still have an entry j are a slice.

Characters are small integers; each string ends in its only 0.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range behind the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _smaller(text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one of its string; the last of a string is."""
    n = len(text)
    rises = np.zeros(n, np.int8)  # 1: smaller, -1: greater, 0: as the next position
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[last] = 1
    known = np.flatnonzero(rises)
    return rises[known[np.searchsorted(known, np.arange(n))]] > 0


class _Induced:
    """One level of the recursion: texts, types, buckets and the two passes."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        self.text, self.lengths, n = text, lengths, len(text)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.small = _smaller(text, self.ends - 1)
        first = np.zeros(n, bool)
        first[self.starts] = True
        self.leftmost = self.small & ~first
        self.leftmost[1:] &= ~self.small[:-1]
        lane = np.repeat(np.arange(len(lengths)), lengths)
        letters = np.maximum.reduceat(text, self.starts).astype(np.int64) + 1
        offset = np.cumsum(letters) - letters
        self.bucket = text + offset[lane]
        count = np.bincount(self.bucket, minlength=int(letters.sum()))
        self.bucket_end = np.cumsum(count)
        self.bucket_start = self.bucket_end - count
        # what the suffix at v places: the bucket of v - 1 if that has the type of the pass, else none (the last bucket)
        self.none = len(count)
        before = np.full(n + 1, self.none)
        before[1:n] = self.bucket[:-1]
        before[self.starts] = self.none
        smaller = np.zeros(n + 1, bool)
        smaller[1:n] = self.small[:-1]
        self.greater_before = np.where(smaller, self.none, before)
        self.smaller_before = np.where(smaller, before, self.none)
        self.active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")

    def induce(self, leftmost: np.ndarray) -> np.ndarray:
        """The suffix array that follows from the order of `leftmost`, positions in order of string and suffix."""
        n, none = len(self.text), self.none
        array = np.full(n + 1, n)  # n: no entry; the place n takes what is not placed
        at = self.bucket[leftmost]
        new = np.append(True, at[1:] != at[:-1])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        size = np.bincount(at, minlength=none)
        array[self.bucket_end[at] - size[at] + rank] = leftmost
        into, place = np.append(self.bucket_start, n), self.greater_before
        for j, m in enumerate(self.active.tolist()):
            v = array.take(self.starts[:m] + j)
            b = place.take(v)
            to = into.take(b)
            array[to] = v - 1
            into[b] = to + 1
            into[none] = array[n] = n
        into, place = np.append(self.bucket_end - 1, n), self.smaller_before
        # the leftmost are placed anew with all smaller suffixes, before they are read
        for j, m in reversed(list(enumerate(self.active.tolist()))):
            v = array.take(self.starts[:m] + j)
            b = place.take(v)
            to = into.take(b)
            array[to] = v - 1
            into[b] = to - 1
            into[none] = array[n] = n
        array[self.starts] = self.ends - 1
        return array[:n]


def _named(level: _Induced, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-smaller substrings as numbers, in order of position, from the order of those; and whether a string has equal ones."""
    places = np.flatnonzero(level.leftmost)
    stop = np.append(places[1:], len(level.text) - 1)
    is_end = np.zeros(len(level.text), bool)
    is_end[level.ends - 1] = True
    length = np.where(is_end[places], 1, stop - places + 1)
    number = np.zeros(len(level.text), np.int64)
    number[places] = np.arange(len(places))
    ranked = number[order]
    one, two = ranked[:-1], ranked[1:]
    lane = np.searchsorted(level.ends, order, side="right")
    same = (length[one] == length[two]) & (lane[1:] == lane[:-1])
    check = np.flatnonzero(same)
    if len(check):
        sizes = length[one[check]]
        equal = level.text[_spread(places[one[check]], sizes)] == level.text[_spread(places[two[check]], sizes)]
        same[check] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
    steps = np.append(0, ~same)
    steps[np.append(True, lane[1:] != lane[:-1])] = 0
    total = np.cumsum(steps)
    head = np.append(True, lane[1:] != lane[:-1])
    names = np.empty(len(places), np.int64)
    names[ranked] = total - np.maximum.accumulate(np.where(head, total, 0))
    return names, np.bincount(lane[1:][same], minlength=len(level.lengths)) > 0


def arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays (positions in `text`) of strings that lie one behind the other, the longest first."""
    if not len(text):
        return np.zeros(0, np.int64)
    level = _Induced(text, lengths)
    places = np.flatnonzero(level.leftmost)
    lane = np.searchsorted(level.ends, places, side="right")
    order = level.induce(places[np.lexsort((level.text[places], lane))])
    order = order[level.leftmost[order]]
    names, repeated = _named(level, order)
    if repeated.any():
        # the reduced strings of those that have equal names, the longest first
        count = np.bincount(lane, minlength=len(lengths))
        start = np.cumsum(count) - count
        again = np.flatnonzero(repeated)
        again = again[np.argsort(-count[again], kind="stable")]
        of = _spread(start[again], count[again])
        below = arrays(names[of], count[again])
        sorted_ = np.empty(len(places), np.int64)
        plain = ~repeated[lane]
        sorted_[start[lane[plain]] + names[plain]] = places[plain]
        sorted_[of] = places[of[below]]
        order = sorted_
    return level.induce(order)


def permuted_prefixes(text: np.ndarray, lengths: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix, in order of position, with the one before it in its string's array, `most` at most.

    A prefix is one shorter at most than that of the position before, so only further
    characters are compared, four at a time.
    """
    n, ends = len(text), np.cumsum(lengths)
    starts = ends - lengths
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[starts]] = -1
    wide = np.zeros(n + 4, np.uint64)
    wide[:n] = text
    four = wide[:n].copy()
    for k in range(1, 4):
        four |= wide[k : n + k] << np.uint64(16 * k)
    found = np.zeros(n, np.int64)
    at, length, lane = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts))
    while len(at):
        other = before[at]
        none = other < 0
        differ = four[np.minimum(at + length, n - 1)] ^ four[np.minimum(other + length, n - 1)]
        low = differ & (~differ + np.uint64(1))
        more = np.where(differ == 0, 4, (low > 0xFFFF).astype(np.int64) + (low > 0xFFFFFFFF) + (low > 0xFFFFFFFFFFFF))
        length = np.where(none, 0, np.minimum(length + more, most))
        done = none | (differ != 0) | (length >= most)
        found[at[done]] = length[done]
        length = np.where(done, np.maximum(length - 1, 0), length)
        at = at + done
        go = at < ends[lane]
        if not go.all():
            at, length, lane = at[go], length[go], lane[go]
    return found


def batches(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """(first, end) of runs of strings, ordered by length, of about `most` characters together."""
    cuts, total = [0], 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            cuts.append(i)
            total = 0
        total += n
    return list(pairwise([*cuts, len(lengths)])) if lengths else []
