"""Near copies of the pipeline against all pairs."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from lotwright.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(400)}" for _ in range(n))


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def plain_groups(rows):
    """The least id of each row's component of pairs at 0.8 or more."""
    sets, part = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sets, 2):
        if part[a] != part[b] and likeness(sets[a], sets[b]) >= near.LEAST:
            low, high = sorted((part[a], part[b]))
            part = {i: low if p == high else p for i, p in part.items()}
    return part


def edited(seed, n, count):
    words = prose(seed, n).split()
    for k in range(count):
        at = (seed * 7919 + k * (n // (count + 1)) + 13) % n
        words[at] = f"edit{seed}x{k}"
    return " ".join(words)


def near_rows():
    """Texts of 60 to 900 words with copies of 1 to 8 replaced words, and a chain of copies of copies."""
    rows = []
    for seed in range(1, 61):
        n = 60 + 14 * seed
        rows += [(10 * seed, prose(seed, n)), (10 * seed + 1, edited(seed, n, 1 + seed % 8))]
    words = prose(999, 200).split()
    for k in range(12):
        words[k * 16 + 5] = f"step{k}"
        words[k * 16 + 11] = f"leap{k}"
        rows.append((5000 + k, " ".join(words)))
    return rows


def test_pipeline_near_stage_matches_all_pairs(spark):
    rows = near_rows()
    want = plain_groups(rows)
    assert sum(i != p for i, p in want.items()) > 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_groups(docs).collect()} == want
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_tiles_and_large_runs_lose_no_link(spark, monkeypatch):
    rows = near_rows()[-12:] + [(6000 + k, edited(777 + k % 3, 200, 1 + k % 7)) for k in range(40)]
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for run, tile in ((4096, 512), (4, 512), (4096, 5)):
        monkeypatch.setattr(near, "RUN_ROWS", run)
        monkeypatch.setattr(near, "TILE_ROWS", tile)
        assert {r.doc_id: r.component_id for r in near.near_groups(docs).collect()} == want


def test_shared_counts_match_plain_sets(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 30, dtype=np.uint64)) for _ in range(9)]
    for columns in (near.COLUMNS, 7):
        monkeypatch.setattr(near, "COLUMNS", columns)
        got = near.shared_counts(sets[:4], sets[4:])
        assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[4:]] for x in sets[:4]]


def test_near_survivors_of_repeated_ids(spark):
    f, g = prose(1, 80), prose(2, 80)
    rows = [(3, f), (5, g), (5, f), (5, g + " "), (None, g), (None, prose(4, 80)), (8, None), (9, "")]
    left = near.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(3, f), (5, g + " "), (None, prose(4, 80)), (8, None)], key=str)


def test_near_edges(nothing, docs, unique, clashing):
    assert near.near_groups(nothing).count() == 0
    want = plain_groups([(r.doc_id, r.text) for r in unique.collect()])
    assert {r.doc_id: r.component_id for r in near.near_groups(unique).collect()} == want
    assert sorted(map(str, near.near_groups(docs).collect())) == sorted(map(str, near.near_groups(clashing).collect()))
    assert near.survivors(clashing).columns == clashing.columns
    assert near.survivors(nothing).count() == 0
