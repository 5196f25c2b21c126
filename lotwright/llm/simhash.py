"""SimHash near-dedup with pivot distance tables.

A fingerprint bit is set where over half of the hashes of a text's shingles have it
set. Fingerprints at 2 or fewer differing bits are linked, and the connected
components are the groups of near copies.

Candidates. Of the three parts of a fingerprint, 2 differing bits leave one equal,
and of the three parts of the rest another. So fingerprints that link share one of
nine keys, each of two parts and about 35 bits. A key held by more than RUN_ROWS
distinct fingerprints is replaced by its three refinements, again and again; as each
fixes a third of the bits that are left, no key stays large. Only distinct
fingerprints are shuffled, each with its smallest doc_id.

Pivots. Every candidate run carries the table of Hamming distances to PIVOTS
reference fingerprints. By the triangle inequality, a pair with a coordinate that
differs by more than 2 can't link; it is discarded by its largest coordinate
difference, and the survivors are verified bit by bit. Of a run only a spanning
forest of its links goes on, as many links as rows at most, which leaves components
as they are. Links join fingerprints; ids only name what they join.

Defined cases: no words (null text included) gives fingerprint zero, linked like any
other; fewer words than a shingle hash as one sequence; a very long text is summed
slice by slice; repeated rows and ids are members like any other, a row with its own
text; rows without id link like any other, and name a component (by null) only where
no row of it has an id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
PIVOTS = 16
RUN_ROWS = 4096
SLICE = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):  # a hash takes 64 bytes here, so a very long text is summed slice by slice
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", simhash(F.coalesce("text", F.lit(""))).alias("fp"))


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def _paths(level: int) -> dict[int, int]:
    """Of each path of `level` choices of a third, its number and the mask of its bits."""
    paths = {1: (0, list(range(BITS)))}
    for _ in range(level):
        paths = {
            4 * n + k: (mask | sum(1 << b for b in part), [b for b in rest if b not in part])
            for n, (mask, rest) in paths.items()
            for k, part in enumerate(_thirds(rest))
        }
    return {n: mask for n, (mask, _) in paths.items()}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, level: int, within: bool) -> DataFrame:
    """Rows (fp, path, part) of each path of a level; `within`: only paths that refine the rows' own."""
    paths = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).cast("long").alias("mask")) for n, m in _paths(level).items()])
    chosen = F.filter(paths, lambda p: F.floor(p["n"] / 4) == F.col("path")) if within else paths
    return rows.withColumn("p", F.explode(chosen)).select("fp", F.col("p.n").alias("path"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("part"))


def candidates(distinct: DataFrame) -> DataFrame:
    """Rows (fp, path, part) of `distinct` (fp); fingerprints that link share a (path, part)."""
    level, rows = 2, common.store(_keyed(distinct, 2, False), "simhash-key")
    settled = None
    while level < 6:
        hot = common.store(rows.groupBy("path", "part").count().filter(F.col("count") > RUN_ROWS).select("path", "part"), "simhash-hot")
        if hot.isEmpty():
            break
        cold = rows.join(hot, ["path", "part"], "left_anti").select("fp", "path", "part")
        settled = cold if settled is None else settled.unionByName(cold)
        level += 1
        rows = common.store(_keyed(rows.join(hot, ["path", "part"], "left_semi"), level, True), "simhash-key")
    return rows if settled is None else settled.unionByName(rows)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints, fixed random numbers."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.arange(count, dtype=np.uint64) % np.uint64(2)


def run_links(fps: np.ndarray, references: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links within a run of fingerprints.

    A fingerprint is a row of 64-bit numbers.
    """
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)
    table = np.column_stack([apart(fps, r) for r in references])
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[np.abs(table[left] - table[x]).max(axis=1) <= distance]
            near = near[apart(fps[near], fps[x]) <= distance]
            if len(near):
                links += zip(repeat(x), near.tolist())
                queue += near.tolist()
                left = left[~np.isin(left, near)]
    return links


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows batch by batch, none of which parts the rows of a key; a key's rows must be few."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        other = np.zeros(len(rows), bool)
        for k in keys:
            other |= (rows[k] != rows[k].iloc[-1]).to_numpy()
        whole = int(other.sum())  # the last run may go on in the next batch
        held = rows.iloc[whole:]
        if whole:
            yield rows.iloc[:whole]
    if held is not None and len(held):
        yield held


def runs_of(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """First and end of each run of equal keys in sorted rows."""
    new = np.zeros(len(rows), bool)
    for k in keys:
        column = rows[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    yield from pairwise([0, *np.flatnonzero(new).tolist(), len(rows)])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of linked fingerprints of `distinct` (fp) that connect all that links connect."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        references = pivots()
        for rows in whole_runs(batches, ["path", "part"]):
            fps, out = rows["fp"].to_numpy(np.int64), []
            for s, e in runs_of(rows, ["path", "part"]):
                if e - s > 1:
                    out += [(fps[s + i], fps[s + j]) for i, j in run_links(fps[s:e].view(np.uint64)[:, None], references, distance)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    keyed = candidates(distinct).repartition("path", "part").sortWithinPartitions("path", "part", "fp")
    return keyed.select("path", "part", "fp").mapInPandas(search, "a long, b long")


def near_groups(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row of `docs`."""
    marked = common.store(fingerprints(docs, size), "simhash-fp")
    distinct = common.store(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    grouped = components(links(distinct.select("fp"), distance))
    parts = distinct.join(grouped, distinct.fp == grouped.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    parts = common.store(parts, "simhash-part")
    least = parts.groupBy("part").agg(F.min("id").alias("component_id"))
    named = common.store(parts.join(least, "part").select("fp", "component_id"), "simhash-component")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    groups = near_groups(common.documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
