"""Lists within names, and looking records up, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lotwright.functions import evidence as E
from lotwright.functions import lists
from lotwright.functions import normalise as N
from lotwright.operators import lookup


def of(spark, values, *columns, schema="v string"):
    frame = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r.out for r in frame.select("i", columns[0].alias("out")).orderBy("i").collect()]


def test_lists_in_names(spark):
    cases = {
        "Установка, варианты исполнения: AJ11, AJ12; AJ15, с принадлежностями": ["AJ11", "AJ12", "AJ15"],
        "Аппарат модели X1, x1, X2 и другие, X3": ["X1"],
        "Аппарат в исполнении: «М-1», (М-2), М.3": ["М-1", "М-2", "М.3"],
        "Аппарат модель: для детей, A1, A2": ["A1", "A2"],
        "Аппарат без списка A1, A2": [],
        "модель A1": [],
        "модели 1, 2, 3": [],
        "МОДЕЛИ A1,A2": ["A1", "A2"],
        None: [],
    }
    want = [w if len(w) > 1 else [] for w in cases.values()]
    assert of(spark, list(cases), lists.named_variants(F.col("v"))) == want


def test_the_longer_list_stands(spark):
    cases = [("A; B;", "модели A1, A2, A3"), ("A; B; C", "модели A1, A2, A3"), (None, "модели A1, A2"), ("A", None), (" ; ", "")]
    assert of(spark, cases, lists.registry_list(F.col("v"), F.col("n")), schema="v string, n string") == [["A1", "A2", "A3"], ["A", "B", "C"], ["A1", "A2"], ["A"], []]


def test_twins_of_a_family(spark):
    cases = {"Birusa Birusa-114": "Birusa-114", "Birusa-114 Birusa": "Birusa-114", "Mercury DA-3 Mercury": "Mercury DA-3 Mercury", "Convelar 1000 Convelar-2 X": "Convelar-2 1000 X", "Луч Луч-2": "Луч Луч-2", "одно": "одно", "": "", None: None}
    assert of(spark, list(cases), lists.without_twins(F.col("v"))) == list(cases.values())


def test_texts_before_their_articles(spark):
    cases = [("Набор: (A-1), (A-2)", ["A-1"]), ("Набор A-1", ["A-1"]), ("A-1 набор", ["A-1"]), ("Набор", []), ("Один, два; A-1", ["A-1", "A-2"]), (": A-1", ["A-1"])]
    assert of(spark, cases, lists.before_articles(F.col("v"), F.col("a")), schema="v string, a array<string>") == ["Набор", "Набор", "A-1 набор", "Набор", "Один, два", ": A-1"]


LETTERS = "абвё xyz-"


def texts(rng, n, most):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_phrases_within_texts(spark):
    rng = random.Random(2)
    held, asked = [*texts(rng, 150, 14), None], [*texts(rng, 80, 5), None, "А", "  xy "]
    records = spark.createDataFrame(list(enumerate(held)), "r int, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "q int, phrase string")
    fold = lambda s: (s or "").lower().replace("ё", "е")
    want = {(q, r) for q, p in enumerate(asked) for r, t in enumerate(held) if fold(p).strip(" ") and fold(p).strip(" ") in fold(t)}
    hits = lookup.containing(questions, records)
    assert {tuple(r) for r in hits.collect()} == want and hits.count() == len(want)
    for r in lookup.by_name(questions, records, "text", too_broad=20).collect():
        mine = sorted(b for a, b in want if a == r.q)
        assert (r.total, r.too_broad) == (len(mine), len(mine) > 20) and r.records == (mine if 0 < len(mine) <= 20 else None)


FIRMS = [("Гюнтер Биссингер Медицинтехник ГмбХ", None), ("Bissinger GmbH", "ООО Биссингер Рус"), ("ООО Эстэн", None), ("Karl Storz", "ООО Восток"), (None, "ООО Восток"), ("Биссингер", None)]


def test_firms(spark):
    records = spark.createDataFrame([(i, *f) for i, f in enumerate(FIRMS)], "r int, producer string, declarant string")
    ask = lambda names: spark.createDataFrame(list(enumerate(names)), "q int, phrase string")
    got = {r.q: (r.field, r.total, r.too_broad, r.records) for r in lookup.by_firm(ask(["bissinger", "Восток", "эст", None, "нигде"]), records).collect()}
    assert got == {0: ("producer", 1, False, [1]), 1: ("declarant", 2, False, [3, 4]), 2: (None, 0, False, None), 3: (None, 0, False, None), 4: ("declarant", 0, False, None)}
    assert {r.q: r.too_broad for r in lookup.by_firm(ask(["Биссингер"]), records, too_broad=1).collect()} == {0: True}
    found = lookup.firm_records(ask(["BISSINGER", "Storz", "STORZ SE"]), records).collect()
    assert sorted(map(tuple, found)) == [(0, 0), (0, 1), (0, 5), (1, 3)]


def test_numbers(spark):
    rows = [(0, "РЗН 2016/4964", "ООО Луч"), (1, "РЗН 2016/4964", "Луч"), (2, "ФСЗ 2012/1", "Луч"), (3, "ФСЗ 2012/1", "Эстэн"), (4, "X/1", None), (5, "", "Луч")]
    records = spark.createDataFrame(rows, "r int, number string, producer string")
    asked = spark.createDataFrame([(0, "рзн 2016/4964"), (1, "ФСЗ 2012/1"), (2, "X/1"), (3, ""), (4, None), (5, "РЗН 2016/496")], "q int, number string")
    assert sorted(map(tuple, lookup.confirmed_number(asked, records).collect())) == [(0, 0), (2, 4)]


@pytest.mark.parametrize("most", [3, 40])
def test_cards_by_name(spark, most):
    rng = random.Random(6)
    words = ["аппарат", "аппарата", "аппаратный", "давления", "давление", "измеритель", "для", "установка", "установки", "зонд", "набор", "и", "XR7"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    cards, kinds = [(f"c{i}", name()) for i in range(80)], [(i, name()) for i in range(40)]
    cards_frame, kinds_frame = spark.createDataFrame([*cards, (None, "аппарат"), ("c1", "я потом")], "code string, name string"), spark.createDataFrame(kinds, "q int, name string")
    pairs = kinds_frame.withColumnRenamed("name", "kind").crossJoin(cards_frame.filter("code is not null and name <> 'я потом'"))
    flat = lambda c: F.regexp_replace(N.folded(c), "[^a-zа-я0-9]+", "")
    graded = {}
    for r in pairs.select("q", "code", ((flat(F.col("kind")) == flat(F.col("name"))) & (flat(F.col("kind")) != "")).alias("e"), E.name_match(F.col("kind"), F.col("name")).alias("m")).collect():
        if r.e or r.m >= 0.5:
            graded.setdefault(r.q, []).append((not r.e, -1.0 if r.e else -r.m, r.code))
    want = {(q, i + 1, c, round(-m, 6), not e, len(g), len(g) > most) for q, g in graded.items() for i, (e, m, c) in enumerate(sorted(g)[:most])}
    got = lookup.by_card_name(kinds_frame, cards_frame, most).collect()
    assert {(r.q, r.place, r.code, r.match, r.exact, r.found, r["cut"]) for r in got} == want and len(got) == len(want)


def test_described_variants(spark):
    hints = F.array(F.lit("Установка стоматологическая"))
    cases = {
        "Вариант исполнения: установка Ajax AJ15; варианты исполнения: AJ16 (тип": ["Ajax AJ15", "AJ16 (тип)"],
        "<li>I. Ajax&nbsp;AJ11, в составе: блок</li><li>2. AJ12 - 3 шт.</li><li>3. кресло AJ13</li><li>4. паспорт AJ</li>": ["Ajax AJ11", "AJ12"],
        "модели без знаков": [],
        None: [],
        "; ".join(f"серия A{i}" for i in range(20)): [f"A{i}" for i in range(12)],
    }
    assert of(spark, list(cases), lists.described_variants(F.col("v"), hints)) == list(cases.values())


def test_known_numerals_stay(spark):
    from lotwright.functions import marks as M

    cases = [("Mercury II", ["ii"]), ("Mercury II", ["IV"]), ("Mercury II IV", ["II"]), ("Mercury IV.", None), ("Mercury", ["II"])]
    assert of(spark, cases, M.tidy_mark(F.col("v"), F.col("k")), schema="v string, k array<string>") == ["Mercury II", "Mercury", "Mercury II", "Mercury", "Mercury"]


def test_equal_texts_are_looked_at_once(spark, monkeypatch):
    """What is stored grows with different texts and not with records; broad questions read no records."""
    kept, plain = {}, lookup.store
    monkeypatch.setattr(lookup, "store", lambda df, name: kept.setdefault(name, plain(df, name)))
    records = spark.createDataFrame([(i, "Лампа" if i < 6 else None if i == 6 else "Лампа X") for i in range(9)], "r int, title string")
    asked = spark.createDataFrame([("a", "лампа"), ("b", "X"), ("c", "нет"), ("d", None)], "q string, phrase string")
    got = sorted(tuple(r) for r in lookup.by_name(asked, records, "title", too_broad=5).collect())
    assert got == [("a", 8, True, None), ("b", 2, False, [7, 8]), ("c", 0, False, None), ("d", 0, False, None)]
    assert kept["lookup-hits"].count() == 3


def test_equal_card_names_are_graded_once(spark):
    """Codes come in after the names are graded, and all of them count."""
    cards = spark.createDataFrame([(f"c{i}", "Лампа для ламп" if i % 2 else "Лампа") for i in range(6)], "code string, name string")
    told = lookup.by_card_name(spark.createDataFrame([("q", "Лампа")], "q string, name string"), cards, most=4)
    assert [(r.place, r.code, r.exact, r.found, r.cut) for r in told.orderBy("place").collect()] == [(1, "c0", True, 6, True), (2, "c2", True, 6, True), (3, "c4", True, 6, True), (4, "c1", False, 6, True)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("AS match") :]  # what the grading reads
    assert "Aggregate [card" in below
