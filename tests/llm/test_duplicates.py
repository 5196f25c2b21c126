import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lotwright.llm import components, exact, simhash, substring

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups_match_brute_force(docs, rows):
    got = sorted(exact.exact_groups(docs).collect(), key=str)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i))
    assert len(got) == len(rows)
    want = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): (want[k][2], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_exact_survivors_are_whole_rows(docs, rows):
    left = exact.survivors(docs)
    assert left.columns == docs.columns
    texts = [BLANK.sub("", r.text or "") for r in left.collect()]
    assert sorted(texts) == sorted({BLANK.sub("", t or "") for _, t, *_ in rows})


def test_exact_survivors_of_repeated_ids_keep_the_longest(spark, clashing):
    rows = [(1, "a b"), (1, "ab"), (1, " a  b "), (1, "c"), (2, "ab"), (None, "d"), (None, "d e"), (None, "de  ")]
    left = exact.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, " a  b "), (1, "c"), (None, "d"), (None, "de  ")], key=str)
    assert exact.survivors(clashing).columns == clashing.columns


def test_chunks_join_to_the_text_and_resume_after_an_edit(spark):
    text = "".join(f"s{i * i}abcdefgh" * 9 + "." for i in range(400))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(exact.chunks(exact.normalised("t")).alias("c")).first().c
    a, b = cut(text), cut("inserted" + text)
    assert "".join(a) == text and max(map(len, a)) <= exact.CHUNK_MOST
    assert len(set(a) & set(b)) > len(a) / 2


def test_unverified_chunks_fall_back_to_the_text(docs, monkeypatch):
    want = sorted(map(str, exact.exact_groups(docs).drop("n_chunks").collect()))
    whole = exact.chunk_dictionary
    monkeypatch.setattr(exact, "chunk_dictionary", lambda r: whole(r).selectExpr("chunk_id", "occurrences", "false as verified"))
    assert sorted(map(str, exact.exact_groups(docs).drop("n_chunks").collect())) == want


def test_exact_of_nothing_and_other_columns(nothing, docs, clashing):
    assert exact.exact_groups(nothing).count() == 0
    assert sorted(map(str, exact.exact_groups(docs).collect())) == sorted(map(str, exact.exact_groups(clashing).collect()))


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_matches_brute_force(unique):
    prints = {r.doc_id: plain_fingerprint(r.text or "") for r in unique.collect()}
    edges = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_components(sorted(prints), edges)
    assert len(set(want.values())) < len(want) - 5
    got = simhash.near_groups(unique).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (p, want[i]) for i, p in prints.items()}


def test_fingerprint_of_a_long_text_is_summed_in_slices(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(500))
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprints_near_each_other_link_in_small_and_refined_runs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {0: centre}
    for i in range(1, 220):
        start = prints[int(rng.integers(len(prints)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            start ^= 1 << int(b)
        prints[i] = start
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints.values()})
    edges = [(p, q) for p, q in combinations(signed, 2) if ((p ^ q) % (1 << 64)).bit_count() <= 2]
    want = plain_components(signed, edges)
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (4096, 8):
        monkeypatch.setattr(simhash, "RUN_ROWS", most)
        got = {r.node: r.component for r in components.components(simhash.links(distinct)).collect()}
        assert {p: got.get(p, p) for p in want} == want


def test_fingerprints_link_through_rows_without_id_and_repeated_ids(spark, monkeypatch):
    rows = [(1, 0), (None, 3), (2, 15), (7, 1 << 40), (7, 1 << 20), (None, 0xFFFF << 30), (None, 0x1FFFF << 30)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs)
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, p, 1 if p < 1 << 41 else None) for i, p in rows), key=str)


def test_simhash_edges(nothing, docs, clashing, spark):
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.near_groups(docs).count() == docs.count()
    pick = lambda d: sorted(map(str, simhash.near_groups(d).collect()))
    assert pick(docs) == pick(clashing)


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*path, *star, (5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 40))


def plain_removal(rows, window=20):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    place = lambda i: (i is None, i or 0)
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (place(i), s))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (place(i), s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_matches_brute_force(docs, rows):
    repeated = [*rows, (9000, " ".join(f"w{i % 7}" for i in range(200)), "en", "s", 0), (9001, " ".join(f"w{i % 7}" for i in range(200)), "en", "s", 0)]
    frame = docs.sparkSession.createDataFrame(repeated, docs.schema).repartition(4)
    want = plain_removal(repeated)
    assert sum(x[2] for x in want) > 1000
    assert sorted(map(tuple, substring.deduped(frame).collect()), key=str) == want
    # many packs, many blocks and a sketch of a few cells, whose errors the exact pass mends
    got = substring.deduped(frame, pack_bytes=20_000, cell_bits=14).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_substring_keeps_words_that_rolling_hashes_confuse(spark):
    """Thue-Morse words collide under any polynomial hash modulo 2**64."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(i, " ".join([*(f"w{k}" for k in range(19)), x])) for i, x in enumerate((one, two, one))]
    got = {r.doc_id: r.n_removed for r in substring.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 20}


def test_sketch_never_underestimates_and_adds_up_copies_of_a_pack():
    import pandas as pd

    hashes = np.random.default_rng(3).integers(0, 1 << 62, 5000, dtype=np.uint64)
    packs = [hashes[:3000], hashes[2900:], np.repeat(hashes[100:101], 50)]
    for row in range(substring.ROWS):
        counters = [substring.Counters(h, row, 2, 10) for h in packs]
        messages = []
        for p, c in enumerate(counters):
            for block, s, e in substring._blocks(c.codes, 10):
                cells = (c.codes[s:e] & np.uint64(1023)).astype(np.uint32)
                messages.append((p, row, block, e - s, substring._planes(np.diff(cells, prepend=np.uint32(0))) + np.packbits(c.counts[s:e] > 1).tobytes()))
        frame = pd.DataFrame(messages, columns=["p", "row", "block", "n", "blob"])
        answers = pd.concat([substring._merge_sketch(10)(g) for _, g in frame.groupby("block")])
        total = np.zeros(1 << 12, int)
        for c in counters:
            np.add.at(total, c.codes.astype(int), c.counts)
        assert len(answers) == len(frame) and total.sum() == sum(map(len, packs))
        for p, c in enumerate(counters):
            mine = answers[answers.p == p].sort_values("block")
            bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=e - s) for b, (_, s, e) in zip(mine.bits, substring._blocks(c.codes, 10), strict=True)])
            assert (bits.astype(bool) == (total[c.codes.astype(int)] > 1)).all()


def test_substring_of_nothing_and_other_columns(nothing, docs, clashing):
    assert substring.deduped(nothing).count() == 0
    assert sorted(map(str, substring.deduped(docs).collect())) == sorted(map(str, substring.deduped(clashing).collect()))
    text = substring.deduped(docs, with_text=True).filter("doc_id = 403").first()
    assert text.kept_text == "one"
