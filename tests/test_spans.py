"""Candidate marks of names, by hand and against a word-by-word version."""

import random

from pyspark.sql import functions as F

from lotwright.functions import spans


def of(spark, values, column):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


def test_candidates(spark):
    cases = {
        'Аппарат ультразвуковой "РуСкан 70П" по ТУ': [("РуСкан 70П", 14)],
        "Установка стоматологическая Mercury Safety М8, модель AJ-15": [("Mercury Safety М8", 7), ("AJ-15", 7)],
        "Светильник хирургический ЭМАЛЕД 500/300 тип II": [("ЭМАЛЕД 500/300", 6)],
        "прибор медицинский": [],
        "Кресло К.А. Иванова 12 мм": [("К.А. Иванова 12", 4)],
        "Кресло К.В. Иванова 12 мм": [("Иванова 12", 4), ("К", 1)],
        'Облучатель ОБН-«Луч»': [("Облучатель ОБН-Луч", 3)],
        "Завод Луч": [],
        "Насос Infusomat® Space, Инфузомат": [("Насос Infusomat", 4), ("Space", 4), ("Инфузомат", 1)],
        None: [],
    }
    got = {v: [tuple(c) for c in out] for v, out in zip(cases, of(spark, list(cases), spans.candidates(F.col("v"))), strict=True)}
    for v, want in cases.items():
        assert got[v] == want, v


def test_quotes(spark):
    assert of(spark, ["«Луч» и \"Луч\", 'ТУ' «мм» «A-1 по ТУ 9452-005-13391002-2014»", None], spans.quoted_marks(F.col("v"))) == [["Луч", "A-1"], []]
    assert of(spark, ["DA-„Pro“ и XR-\"7\" и XR-'70'"], spans.unglued(F.col("v"))) == ["DA-Pro и XR-\"7\" и XR-70"]


WORDS = {"KLT-103": True, "Ajax": True, "ЭМАЛЕД": True, "500": True, "Луч": False, "Эстен": True, "РуСкан": True, "прибор": False, "белый": False, "модель": False, "Модуль": False, "тип": False, "A1/2": True, "x7": True, "II": False}


def plain(words):
    """Runs of telling words between others, by score, then length."""
    runs, run = [], []
    for w in [*words, ","]:
        if WORDS.get(w):
            run.append(w)
        elif run:
            runs, run = [*runs, " ".join(run)], []

    def score(s):
        latin, digit = any("A" <= c <= "z" for c in s), any(c.isdigit() for c in s)
        capitals = any(w == w.upper() and w.isalpha() and not w.isascii() for w in s.split())
        return 3 * latin + 3 * digit + 2 * capitals + (s[0] == s[0].upper() and not s[0].isdigit())

    order = sorted(range(len(runs)), key=lambda i: (-score(runs[i]), -len(runs[i]), i))
    return list(dict.fromkeys((runs[i], score(runs[i])) for i in order))


def test_runs_of_words(spark):
    rng = random.Random(8)
    names = [[rng.choice(list(WORDS)) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    got = of(spark, [" ".join(n) for n in names], spans.candidates(F.col("v")))
    assert [[tuple(c) for c in out] for out in got] == [plain(n) for n in names]
