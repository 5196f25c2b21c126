"""Near copies for the pipeline: SimHash candidates over five-word shingles, exact Jaccard similarity.

Two texts are linked where the Jaccard similarity of their sets of SHINGLE-word
shingles is LEAST or more, and the connected components are the groups of near
copies. `op9_simhash` has settings of its own in `simhash`, whose search of runs by
pivot distance tables serves here too. Texts of equal shingles are one node.

1. Candidates. A node has a SimHash of WORDS * 64 bits, and BANDS keys of ROWS minima
   of permutations each. Pairs at similarity 0.8 share a key with probability
   1 - (1 - 0.8^6)^24 = 0.9993, pairs at 0.9 with all but 1e-8. Nodes of a key are a
   run, in which pairs at FAR or fewer differing bits (a pair at 0.8 has 39 in the
   mean, with a deviation of 6) link, found by the distances to the run's own first
   fingerprints. A run of over RUN_ROWS nodes links as a whole, each to its least.
2. Families are the components of such links. They are too wide, not too narrow: all
   pairs at 0.8 or more that share a key are within one.
3. Verification. A family is cut into tiles of a bounded number of nodes and code
   points; all pairs of two tiles (or within one) are compared exactly, by counting
   shared shingles as a product of matrices. A spanning forest of the pairs at LEAST
   or more goes on, and its components are the groups.

So what is shuffled grows with the texts, however large a group is, but for a family
of many tiles, whose texts go once to each other tile.

Defined cases: texts without words (null included) are near copies of each other;
fewer words than a shingle are one sequence; very long texts are tiles of their own;
repeated rows and ids are members like any other, a row with its own text; null ids
come last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .simhash import run_links, runs_of, whole_runs

SHINGLE = 5
LEAST = 0.8
SEED = 42
WORDS, BANDS, ROWS = 4, 24, 6
FAR = 72
PIVOTS = 16
RUN_ROWS = 4096
TILE_ROWS, TILE_POINTS = 256, 1_000_000
SLICE = 2048
COLUMNS = 2048


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    import xxhash

    words = text.encode().lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Factors, odd, and terms of the permutations of 32-bit numbers, fixed random ones."""
    factors, terms = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
    return factors | np.uint32(1), terms


def minima(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of every permutation; a very long text is taken slice by slice."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), SLICE):
        least = np.minimum(least, (factors[:, None] * high[at : at + SLICE] + terms[:, None]).min(axis=1))
    return least


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, as WORDS unsigned numbers."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        bits = []
        for k in range(WORDS):
            x = (part + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            bits.append(x ^ (x >> np.uint64(29)))
        ones += np.unpackbits(np.column_stack(bits).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


SKETCH = "doc_id long, node long, points long, bands array<long>, bits array<long>"


def node_of(hashes: np.ndarray) -> int:
    """A hash of a set of shingles, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the shingles, length, band keys and SimHash of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        factors, terms = permutations()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                hashes = shingles(text)
                least = minima(hashes, factors, terms).reshape(BANDS, ROWS)
                keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least]
                out.append((doc_id, node_of(hashes), len(text), np.array(keys, np.uint64).view(np.int64), simhash(hashes).view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "node", "points", "bands", "bits"]).astype({"doc_id": "Int64"})

    return _plain(docs).mapInPandas(run, SKETCH)


@F.pandas_udf(T.LongType())
def shingle_node(texts: pd.Series) -> pd.Series:
    """The hash of the shingles of each text."""
    return pd.Series([node_of(shingles(t)) for t in texts], dtype=np.int64)


def candidate_links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all candidates, for stored `distinct` (node, bands, bits)."""
    keys = distinct.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    shared = common.store(shared, "near-run")
    members = common.store(keys.join(shared, ["band", "key"]).select("band", "key", "n", "least", "node"), "near-member")
    large = members.filter((F.col("n") > RUN_ROWS) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["band", "key"]):
            nodes, out = rows["node"].to_numpy(np.int64), []
            prints = np.vstack(rows["bits"].to_numpy()).view(np.uint64)
            for s, e in runs_of(rows, ["band", "key"]):
                out += [(nodes[s + i], nodes[s + j]) for i, j in run_links(prints[s:e], prints[s : min(e, s + PIVOTS)], FAR)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64).drop_duplicates()

    small = members.filter(F.col("n") <= RUN_ROWS).join(distinct.select("node", "bits"), "node")
    small = small.select("band", "key", "node", "bits").repartition("band", "key").sortWithinPartitions("band", "key", "node")
    return small.mapInPandas(search, "a long, b long").union(large)


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one list shares with each of another."""
    sizes = [len(x) for x in one + two]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(np.concatenate(one + two), return_inverse=True, return_counts=True)
    kept = count[column] > 1  # what one set alone has is shared by none
    number = np.cumsum(count > 1) - 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(one), len(two)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, (first, first + COLUMNS))
        table = np.zeros((len(sizes), COLUMNS), np.float32)
        table[owner[s:e], column[s:e] - first] = 1
        total += (table[: len(one)] @ table[len(one) :].T).astype(np.int64)
    return total


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of a symmetric matrix of links."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            x = queue.pop()
            found = np.flatnonzero(near[x] & left)
            left[found] = False
            out += zip(repeat(x), found.tolist())
            queue += found.tolist()
    return out


def tile_links(sets: list[np.ndarray], tiles: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at LEAST or more between two tiles, or within the only one."""
    n = np.array([len(x) for x in sets])
    low = np.flatnonzero(tiles == tiles.min())
    high = low if len(low) == len(tiles) else np.flatnonzero(tiles != tiles.min())
    both = shared_counts([sets[i] for i in low], [sets[i] for i in high])
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(low, high)] = both / (n[low][:, None] + n[high] - both) >= LEAST
    return forest(near | near.T)


def verified(families: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all similar nodes of each family of `families` (node, family)."""
    members = families.join(distinct.select("node", "id", "points"), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("points") / TILE_POINTS)).cast("int").alias("tiles"))
    wanted = common.store(members.join(sizes, "family").select("node", "id", "family", "tiles"), "near-wanted")
    plain = _plain(docs)
    ids = wanted.select("id").distinct()
    rows = plain.join(ids, plain.doc_id.eqNullSafe(ids.id), "left_semi").select(shingle_node("text").alias("node"), "text")
    texts = rows.join(wanted.select("node", "family", "tiles"), "node")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = texts.withColumn("tile", tile).withColumn("other", other)
    dealt = dealt.select("family", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "text")
    keys = ["family", "low", "high"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, keys):
            out = []
            for s, e in runs_of(rows, keys):
                part = rows.iloc[s:e].drop_duplicates("node")
                nodes, tiles = part["node"].to_numpy(np.int64), part["tile"].to_numpy()
                out += [(nodes[i], nodes[j]) for i, j in tile_links(list(map(shingles, part["text"])), tiles)] if len(nodes) > 1 else []
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(compare, "a long, b long")


def near_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, node) of every row of `docs`, and (node, id, part) of every node; part is the group's least node."""
    marked = common.store(sketches(docs), "near-sketch")
    first = [F.first(c).alias(c) for c in ("points", "bands", "bits")]
    distinct = common.store(marked.groupBy("node").agg(F.min("doc_id").alias("id"), *first), "near-distinct")
    families = common.store(components(candidate_links(distinct)).select("node", F.col("component").alias("family")), "near-family")
    # the least node of a family is no row of the components
    families = families.union(families.select("family", "family")).distinct()
    groups = components(verified(families, distinct, docs))
    parts = distinct.select("node", "id").join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("part"))
    return marked.select("doc_id", "node"), common.store(parts, "near-part")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of every row of `docs`."""
    marked, parts = near_parts(docs)
    least = parts.groupBy("part").agg(F.min("id").alias("component_id"))
    named = common.store(parts.join(least, "part").select("node", "component_id"), "near-component")
    return marked.join(named, "node").select("doc_id", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, with the columns of `docs`.

    Where an id occurs more than once, the texts of its rows tell which of them stays.
    """
    _, parts = near_parts(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("node").alias("k"))).alias("s")
    stay = common.store(parts.groupBy("part").agg(first).select(F.col("s.i").alias("k_id"), F.col("s.k").alias("k_key")), "near-stay")
    return common.kept_rows(docs, stay, shingle_node(F.coalesce("text", F.lit(""))), "near")
