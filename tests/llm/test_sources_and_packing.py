import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotwright.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORD.findall(text or ""))


def plain_targets(totals, cap=3):
    """Reshare by weight what capped sources leave, until none is above its cap."""
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        rest = sum(totals.values()) - sum(fixed.values())
        level = rest / sum(weight[s] for s in left)
        above = {s for s in left if level * weight[s] > cap * totals[s]}
        if not above:
            return fixed | {s: level * weight[s] for s in left}
        fixed |= {s: cap * totals[s] for s in above}
        left -= above
    return fixed


def test_targets_follow_the_iterative_rule(spark):
    for totals in ({"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1}, {"b": 0, "c": 7}, {"x": 0}, {"a": 3, "é": 9, "z": 100, "Z": 4}):
        given_ = spark.createDataFrame([(s, 1, t) for s, t in totals.items()], "source string, docs long, total long")
        got = {r.source: r.target for r in mixing.targets(given_).collect()}
        for s, want in plain_targets(totals).items():
            assert got[s] == pytest.approx(want), (totals, s)


def test_mix_meets_targets_and_bounds(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        total[source] += n_words(text)
    want = plain_targets(total)
    assert sum(want.values()) == pytest.approx(sum(total.values()))
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        longest = max(n_words(x[1]) for x in rows if x[3] == s)
        assert abs(taken[s] - t) <= longest, s
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in got) == sorted((r.doc_id or -1, r["size"], r.taken) for r in again)


def test_dual_solves_its_equation(spark):
    histogram = spark.createDataFrame([("a", 10, 100), ("a", 500, 7), ("b", 3, 50), ("b", 40, 2)], "source string, size long, docs long")
    goals = spark.createDataFrame([("a", 107, 4500, 700.0), ("b", 52, 230, 600.0)], "source string, docs long, total long, target double")
    for r in mixing.dual_variables(histogram, goals).collect():
        words = sum(n * s * min(3.0, np.exp(r.dual * s / r["mean"])) for src, s, n in histogram.collect() if src == r.source)
        assert words == pytest.approx(r.target, rel=1e-5)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


def test_mix_ignores_other_columns(docs, clashing):
    pick = lambda d: sorted(map(str, mixing.mix(d).select("doc_id", "size", "taken").collect()))
    assert pick(docs) == pick(clashing)


def test_resampled_keeps_columns_and_counts(unique):
    out = mixing.resampled(unique)
    assert out.columns == unique.columns
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix(unique).collect()}
    got = {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_resampled_of_repeated_rows_takes_what_the_mix_takes(docs, clashing):
    mixed = mixing.mix(docs).collect()
    words = sum(r.taken for r in mixed)
    assert sum(n_words(r.text) for r in mixing.resampled(docs).collect()) == words
    out = mixing.resampled(clashing)
    assert out.columns == clashing.columns and out.count() == mixing.resampled(docs).count()


def check_packing(got, rows, capacity=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.length) == (k, at, min(capacity, len(ids) - at))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for places in by_sequence.values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_is_whole_and_tight(unique):
    got = packing.packed(unique).collect()
    used = check_packing(got, unique.collect())
    assert used <= packing.lower_bound(np.array([r.length for r in got])) + 1


def test_packing_rounds_exchange_pieces(unique, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    got = packing.packed(unique).collect()
    used = check_packing(got, unique.collect())
    assert used <= 1.3 * packing.lower_bound(np.array([r.length for r in got])) + 1


def test_packing_has_the_plain_tokenizers_ids(spark):
    texts = ["<|endoftext|> hello", "a<|endoftext|>b", "<|startoftext|>", "A <|ENDOFTEXT|> b", "<|endof text|>", "It's 12's don't—x", "İstanbul ǅ ß ﬁ", "tab\tand\u00a0space\u2028line", "e\u0301 é"]
    rows = [(i, t) for i, t in enumerate(texts)]
    check_packing(packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_packing_deals_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rows = [(None, "word " * (i % 90)) for i in range(300)] + [(4, "same text") for _ in range(300)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.count() == 600
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r.n == r.e <= 2048 for r in fill)
    assert sum(r.n for r in fill) == sum(i % 90 + 1 for i in range(300)) + 300 * 3
    parts = spark.range(600).select(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(12)).alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 120


def test_packing_of_nothing_and_of_other_columns(nothing, docs, clashing):
    assert packing.packed(nothing).count() == 0
    pick = lambda d: sorted(map(str, packing.packed(d).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert pick(docs) == pick(clashing)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_lower_bound_is_one(lengths):
    """Never above the true optimum, which is found by trying all assignments."""

    def fewest(items, bins):
        if not items:
            return len(bins)
        best, seen = 99, set()
        for i, room in enumerate(bins):
            if room >= items[0] and room not in seen:
                seen.add(room)
                best = min(best, fewest(items[1:], [*bins[:i], room - items[0], *bins[i + 1 :]]))
        return min(best, fewest(items[1:], [*bins, 20 - items[0]]))

    optimum = fewest(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(np.array(lengths, np.int64), 20) <= optimum
    _, _, fill = packing.best_fit_decreasing(np.array(lengths, np.int64), 20)
    assert sum(lengths) == fill.sum() and len(fill) >= optimum and (not lengths or fill.max() <= 20)


def test_ids_of_words_like_special_tokens():
    """Names of special tokens in any case beside control characters and letters whose case changes their bytes."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", *"\x1c\x1f\x85\x00 \t\n\x0b_", "Don't", "'S", *"ÉßİſK♥𝒳é", "12", "a1b2", "</w>", "x" * 50]
    rng = np.random.default_rng(5)
    texts = ["".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(0, 10))) for _ in range(20_000)]
    got = packing.word_ids(packing.default_vocabulary()).of(texts)
    assert [t for t, ids in zip(texts, got, strict=True) if np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() != ids] == []
