"""Domain cases of the column functions and text rules."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lotwright.functions import companies as C
from lotwright.functions import evidence as E
from lotwright.functions import identifiers as I
from lotwright.functions import marks as M
from lotwright.functions import names
from lotwright.functions import normalise as N
from lotwright.functions import prices


def of(spark, values, function, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, " + schema)
    return [r.out for r in frame.select("i", function.alias("out")).orderBy("i").collect()]


def test_blank_and_dash(spark):
    assert of(spark, ["  a   b ", "", None, " \t"], N.or_dash(F.col("v"))) == ["a b", "—", "—", "—"]


def test_keys(spark):
    assert of(spark, ["Ёлка  (Нов.)", "A-1/б"], N.name_key(F.col("v"))) == ["елка нов", "a 1 б"]
    assert of(spark, ["АJ-15", "AJ 15"], N.mark_key(F.col("v"))) == ["aj15", "aj15"]
    assert of(spark, ["РЗН 2020/123", "P3H 2020/123"], N.number_key(F.col("v"))) == ["pзh2020/123", "p3h2020/123"]
    assert of(spark, ["Рускан", "RuScan", "РУСКАН"], N.phonetic(F.col("v"))) == ["ruskan"] * 3


def test_company_core_and_form(spark):
    given = ['ООО "НПФ Альфа"', "ЗАО Альфа", "Alpha Co., Ltd.", "ООО ООО", None]
    assert of(spark, given, N.company_core(F.col("v"))) == ["научнопроизводственнаяфирмаальфа", "альфа", "alpha", "ооо", None]
    assert of(spark, given, N.legal_form(F.col("v")))[:4] == ["ооо", "ао", "", "ооо"]


def test_money_and_dates(spark):
    assert of(spark, ["1 234,50", "1 000 000.5", "n/a"], N.money(F.col("v"))) == [1234.5, 1000000.5, None]
    got = of(spark, ["2025-03-01T10:00:00+03:00", "01.03.2025", "31.02.2025", "later"], N.date(F.col("v")).cast("string"))
    assert got == ["2025-03-01", "2025-03-01", None, None]


def test_plural(spark):
    got = of(spark, [1, 2, 5, 11, 21, 112], N.plural(F.col("v"), "контракт", "контракта", "контрактов"), "v int")
    assert got == ["контракт", "контракта", "контрактов", "контрактов", "контракт", "контрактов"]


@pytest.mark.parametrize(
    "name, rank",
    [
        ("Электронный контракт.xml (67.08 Кб)", 500), ("Контракт 12.xml", 100), ("Контракт с учетом доп. соглашений 1, 2.xml", 1002),
        ("Контракт с учётом дополнительных соглашений.xml", 1001), ("Дополнительное соглашение 1.xml", -1), ("Счёт на оплату.xml", -1),
        ("Счетчик, контракт.xml", 100), ("Акт.xml", -1), ("Контракт.docx", -1),
    ],
)
def test_attachments(spark, name, rank):
    assert of(spark, [name], I.attachment_rank(I.clean_file_name(F.col("v")))) == [rank]


def test_codes(spark):
    text = "коды 32.50.13.190-00007, 32.50.13.190-00007; 26.60.12-1 и 32.50.13.190"
    assert of(spark, [text], I.catalogue_codes(F.col("v"))) == [["32.50.13.190-00007"]]
    assert of(spark, [text], I.near_codes(F.col("v"))) == [["26.60.12-1", "32.50.13.190"]]
    assert of(spark, ["119630; 12 123456789, 260"], I.kind_codes(F.col("v"))) == [["119630", "260"]]
    assert of(spark, ["№ 0123456789012345678-9", "12"], I.purchase_number(F.col("v"))) == ["0123456789012345678", None]


def test_registrations(spark):
    text = "Аппарат для ингаляционного наркоза «Орфей-М-03» по РУ РЗН 2018/7255 от 03 декабря 2024 года и Компрессор медицинский КМ с принадлежностями по РУ РЗН 2018/6988"
    assert of(spark, [text], I.registrations(F.col("v"))) == [["РЗН 2018/7255", "РЗН 2018/6988"]]
    assert of(spark, [text], I.main_registration(F.col("v"), F.lit("Аппарат для ингаляционного наркоза"))) == ["РЗН 2018/7255"]
    assert of(spark, ["фсз № 2009 / 123, МЗ РФ № 99/12"], I.registrations(F.col("v"))) == [["ФСЗ 2009/123", "МЗ РФ № 99/12"]]
    assert of(spark, ["Лампа по ТУ 9452-005- 13391002-2014", "нет"], I.specification(F.col("v"))) == ["9452-005-13391002-2014", None]


def test_registration_of_many_digits(spark):
    text = "РУ № РЗН 2024/1000100 от 1.1.2020, фсз 2009/123"
    assert of(spark, [text], I.registrations(F.col("v"))) == [["РЗН 2024/1000100", "ФСЗ 2009/123"]]


def test_measures_and_trademarks(spark):
    assert of(spark, ["d=10мм", "302 мм", "AJ15", "8989"], I.is_measure(F.col("v"))) == [True, True, False, False]
    junk = ["отсутствует", "не установлен", "false", "-", "№ 123", "нет", "давление >= 5", "a: b: c", "x"]
    assert of(spark, junk, I.is_trademark(F.col("v"))) == [False] * len(junk)
    assert of(spark, ["OMRON", "Нетрон", "Диакомб"], I.is_trademark(F.col("v"))) == [True] * 3
    marks = ["AJ15", "РУСКАН", "2020 год", "12-34", "НЕТ", "стол", "ДиаМед"]
    assert of(spark, marks, I.looks_like_mark(F.col("v"))) == [True, True, False, False, False, False, True]


def test_services(spark):
    yes = ["Услуги по ремонту", "Техническое обслуживание аппарата", "Текущий ремонт:: Аппарат", "Поверка весов"]
    no = ["Аппарат для ремонта", "Услугин"]
    assert of(spark, yes + no, I.is_service(F.col("v"))) == [True] * 4 + [False] * 2


def test_quotes(spark):
    pairs = [("аппарат Рускан производства", "Аппарат ультразвуковой РУСКАН"), ("выдумано целиком слово", "Аппарат РУСКАН"), ("70п", "ЭГД 70П")]
    assert of(spark, pairs, I.quote_supported(F.col("q"), F.col("t")), "q string, t string") == [True, False, True]


def test_quotes_take_a_text_once(spark, capsys):
    """A text's key stands once in the plan, not in what is asked of each word."""
    frame = spark.createDataFrame([("аппарат Рускан", "Аппарат РУСКАН", True), ("выдумано целиком", "Аппарат", False), ("", "a", False), ("a b", "x a b", True), ("a b", None, False)], "q string, t string, want boolean")
    told = frame.select("want", I.quote_supported(F.col("q"), F.col("t")).alias("got"))
    assert all(r.want == r.got for r in told.collect())
    told.select("got").explain()
    plan = capsys.readouterr().out
    assert len(re.findall(r"lower\(t#", plan)) == 1 and len(re.findall(r"lower\(q#", plan)) == 1


def test_articles(spark):
    assert "aj15" in of(spark, ["Установка Ajax AJ 15 с принадлежностями"], I.article_keys(F.col("v")))[0]
    assert "ajax832695" not in of(spark, ["Ajax (№ 832695)"], I.article_keys(F.col("v")))[0]
    assert of(spark, ["Ajax AJ 15", "AJ-15"], I.phrase_articles(F.col("v"))) == [["aj15"], ["aj15"]]
    assert of(spark, ["Ajax AJ15"], I.phrase_names(F.col("v"))) == [["ajaks"]]


def test_prices(spark):
    rows = [("Электронный аукцион", False, "", 100.0, 80.0), ("Электронный аукцион", False, "", 100.0, 100.0), ("Закупка у единственного поставщика", False, "", 100.0, 100.0), ("аукцион", True, "", 100.0, 90.0), ("аукцион", False, "", 100.0, 120.0), ("аукцион", False, "", None, 1.0), ("Закупка малого объема", False, "", 5.0, 5.0), ("аукцион", False, "", 0.0, 0.0)]
    schema = "way string, amended boolean, note string, nmck double, price double"
    bidding = prices.no_bidding_note(*map(F.col, ("way", "amended", "note", "nmck", "price")))
    notes = of(spark, rows, bidding, schema)
    assert notes == ["—", "—", prices.NO_BIDDING, prices.AMENDED, prices.ABOVE_START, prices.NO_START, prices.SMALL_VOLUME, "—"]
    assert of(spark, rows, prices.discount_percent(bidding, F.col("nmck"), F.col("price")), schema)[:3] == [20.0, 0.0, None]


def test_spellings():
    assert names.spellings("ESTEN") == ["ESTEN", "ЭСТЕН"]
    assert names.spellings("рускан 70п") == ["рускан 70п", "ruskan 70p"]
    assert [names.to_cyrillic(w) for w in ("ESTEN", "Olympus", "Bayer")] == ["ЭСТЕН", "олимпус", "байер"]
    assert names.to_latin("РУСКАН") == "RUSKAN"
    cases = {"рускан 70п": ["рускан"], "ЭГД-70П": ["ЭГД"], "CV 170": ["CV 170"], "Olympus CV-170": ["Olympus"], "Система ультразвуковая РуСкан 70П": ["РуСкан"], "Камера холодильная Бирюса 450": ["Бирюса"]}
    assert {k: names.search_words(k) for k in cases} == cases
    assert len(names.search_words("B.Well PRO-30 Comfort")) == 2


def test_initialisms(spark):
    full = "Досчатинский завод медицинского оборудования"
    pairs = [("ДЗМО", full), (full, "ДЗМО"), ("Медтехника", "Медтехника плюс"), ("ООО «ДЗМО»", f"АО «{full}»"), ("дзмо", full), ("ДЗ медицинского оборудования", full), ("ДЗМ", full), ("", full)]
    assert of(spark, pairs, C.is_initialism(F.col("a"), F.col("b")), "a string, b string") == [True, False, False, True, False, True, False, False]


def test_phonetic_closeness(spark):
    assert of(spark, ["Диксион", "RuScan", "Нечто (Диксион)", None], names.phonetic_close(F.col("v"), F.lit("DIXION"))) == [True, False, True, False]
    assert of(spark, ["Рускан", "RuScan"], N.phonetic(F.col("v"))) == ["ruskan", "ruskan"]


def test_similarity(spark):
    pairs = [("Стол", "стол"), ("", "x"), ("Аппарат для ингаляции", "аппарат для терапии"), ("Камера \"Бирюса\"", "Камера Бирюса медицинская холодильная для хранения крови"), ("камера", "камера медицинская холодильная для хранения крови и плазмы")]
    got = of(spark, pairs, F.round(names.similarity(F.col("a"), F.col("b")), 4), "a string, b string")

    def plain(a, b):
        tidy = lambda t: " ".join(re.sub(r"[\"'«»()\[\]®™]", " ", t.lower().replace("ё", "е")).split())
        x, y = tidy(a), tidy(b)
        sets = [{t for t in re.findall(r"[a-zа-я0-9\-]{3,}", z) if t not in I.KEY_STOP} for z in (x, y)]
        return round(max(SequenceMatcher(None, x, y).ratio(), len(sets[0] & sets[1]) / len(sets[0] | sets[1])), 4) if x and y else 0.0

    assert got == [1.0, 0.0, plain(*pairs[2]), 0.85, plain(*pairs[4])]


def test_kind_names(spark):
    pairs = [("аппарат для ингаляции", "аппарат для терапии"), ("светильники медицинские", "Светильник медицинский передвижной"), ("стол", "стул"), ("кровать для пациента", "пациента кровать"), ("для", "для"), (None, "стол")]
    assert of(spark, pairs, E.name_match(F.col("a"), F.col("b")), "a string, b string") == [0.5, 1.0, 0.0, 1.0, 0.0, 0.0]


COMPANIES = [
    ('"Жухай Сайгер Медикал Ко., Лтд", Китай', "Жухай Сайгер Медикал Ко., Лтд"), ('"Жухай Сайгер Медикал Ко., Лтд", Китай,', "Жухай Сайгер Медикал Ко., Лтд"),
    ('"КИРХНЕР & ВИЛЬГЕЛЬМ ГмбХ + Ко. КГ"', "КИРХНЕР & ВИЛЬГЕЛЬМ ГмбХ + Ко. КГ"), ('ЗАО "ЗАВОД ЭМА"', 'ЗАО "ЗАВОД ЭМА"'), ("«Диксион»", "Диксион"),
    ("ООО «Диксион»", "ООО «Диксион»"), ('ООО "НПЦ МТ "АРМЕД""', 'ООО "НПЦ МТ "АРМЕД""'), ('ЗАО "Завод ЭМА" Российская Федерация (643)', 'ЗАО "Завод ЭМА"'),
    ("ООО «Каскад-ФТО» / Россия", "ООО «Каскад-ФТО»"), ('АО "Завод ЭМА', 'АО "Завод ЭМА"'), ('ООО "НОВГОДЕНТ"', 'ООО "НОВГОДЕНТ"'),
    ("ООО «Медстальконструкция», Российская Федерация", "ООО «Медстальконструкция»"), ("ООО «Ромашка», Китайская Народная Республика", "ООО «Ромашка»"),
    ("ООО «Ромашка», Республика Беларусь", "ООО «Ромашка»"), ('ООО "Корея-Мед"', 'ООО "Корея-Мед"'), ('АО "Республика"', 'АО "Республика"'), (None, ""),
]


def test_clean_companies(spark):
    got = of(spark, [(raw,) for raw, _ in COMPANIES], C.clean_company(F.col("v")), "v string")
    assert got == [want for _, want in COMPANIES]
    assert of(spark, got, C.clean_company(F.col("v"))) == got


def test_same_companies(spark):
    pairs = [("ООО Ромашка", "АО «Ромашка»"), ("Сателек САС", "Сателек САС Франция"), ("ДЗМО", "Досчатинский завод медицинского оборудования"), ("Медтехника", "Медтехника плюс"), ("Диксион", "DIXION"), ("", ""), (None, "x")]
    assert of(spark, pairs, C.same_company(F.col("a"), F.col("b")), "a string, b string") == [True, True, True, False, False, False, False]
    assert of(spark, ["НПП Медтехника (Завод Луч)", "ИП Ли"], C.company_keys(F.col("v"))) == [["научнопроизводственноепредприятиемедтехника", "заводлуч"], []]
    named = [("ООО Ромашка", ""), ("Mindray Co., Ltd", ""), ("Китай", ""), ("Филипс", "Производитель: Филипс, США"), ("Филипс", "Модель: Филипс"), ("12 штук ООО", ""), ("ООО", "")]
    assert of(spark, named, C.is_company_name(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, True, False, False, False]
    forms = [("ИП", "ИП Иванов", "Омск", "Омск"), ("ИП", "ИП Иванов", "Омск", "Томск"), ("ООО Луч", "ООО Луч плюс", "Омск", "Омск"), ("ООО.", "ооо Луч", " Омск", "Омск")]
    mended = C.mended_form(F.col("a"), F.col("b"), (F.col("c"), F.col("d")))
    assert of(spark, forms, mended, "a string, b string, c string, d string") == ["ИП Иванов", "ИП", "ООО Луч", "ооо Луч"]


def test_evidence(spark):
    two = "a string, b string"
    tono = F.array(F.lit("Аппарат для измерения артериального давления электрический с ручным нагнетением, портативный"))
    devices = ["Прибор для измерения артериального давления и частоты пульса цифровой LD", "Измеритель артериального давления и частоты пульса полуавтоматический OMRON", "Стол операционный", None]
    assert of(spark, [(d,) for d in devices], E.same_device_kind(F.col("v"), tono), "v string") == [True, True, False, False]
    marks = [("Камера холодильная медицинская \"Бирюса 450S-R\"", "Камеры холодильные медицинские \"Бирюса\""), ("Стол массажный", "Стол операционный"), ("Камеры холодильные медицинские", "Камеры холодильные медицинские «Бирюса»"), ("Аппарат X", "")]
    assert of(spark, marks, E.shares_mark(F.col("a"), F.col("b")), two) == [True, False, True, False]
    texts = [("Аппарат KLT-6210", "Установка KLT-6220"), ("Аппарат KLT-6210", "KLT-6210, KLT-6220"), ("Аппарат KLT-6210", "Установка"), ("по ТУ 9452-001-90933304-2020 KLT-6210", "KLT 6210"), ("АВС-123", "ABC-123")]
    assert of(spark, texts, E.contradicts(F.col("a"), F.col("b")), two) == [True, False, False, False, False]
    assert of(spark, texts[:2], E.evidence(F.array(F.lit("KLT-6210"), F.lit("zzz")), F.col("a"), F.col("b")), two) == [[], ["KLT-6210"]]
    phrases = [("рускан 70п", "Сканер RuScan, модель ЭГД-70П"), ("рускан 70п", "RuScan 60"), ("", "x"), ("x", "")]
    assert of(spark, phrases, E.phrase_matches(F.col("a"), F.col("b")), two) == [True, False, False, False]
    assert of(spark, phrases[:2], E.any_match(F.array(F.col("a"), F.lit("сканер")), F.col("b")), two) == [True, False]
    assert of(spark, [("РЗН 2020/1", "рзн2020/1"), ("РЗН 2020/1", "РЗН 2020/11"), ("", "")], E.same_number(F.col("a"), F.col("b")), two) == [True, False, False]
    replies = ["Вот: ```{\"a\": \"x {y}\", \"b\": 2}``` {\"c\": 1}", "нет", None]
    assert of(spark, [(r,) for r in replies], E.reply_fields(F.col("v")), "v string") == [{"a": "x {y}", "b": "2"}, {}, {}]
    answers = [("DA 290", "модель DA-290 белая"), ("DA 290", "модель белая"), ("DA 290", "модель ZZ-290 другая"), ("", "модель"), (None, None)]
    assert of(spark, answers, E.variant_supported(F.col("a"), F.col("b"), F.lit("Стул, модель DA-290 белая, с подставкой")), two) == [True, False, False, False, False]


STOM = ["Установка стоматологическая"]
LAMP = ["Светильник передвижной для проведения осмотра/терапевтических процедур"]
TONO = ["Аппарат для измерения артериального давления электрический с ручным нагнетением, портативный"]
GOLDEN = [
    ("РЗН 2021/13711 Установка стоматологическая Mercury Safety с принадлежностями, в вариантах исполнения: II. Установка стоматологическая C2", STOM, "Mercury Safety C2"),
    ("Установка стоматологическая STERN WEBER с принадлежностями: Установка стоматологическая STERN WEBER, вариант исполнения S200 CONTINENTAL", STOM, "STERN WEBER S200 CONTINENTAL"),
    ("Установка стоматологическая DIPLOMAT с принадлежностями, модель ADEPT, вариант исполнения DA 290", STOM, "DIPLOMAT ADEPT (DA 290)"),
    ("Установка стоматологическая ANTHOS, вариант исполнения A3 PLUS", STOM, "ANTHOS A3 PLUS"),
    ("РЗН 2015/2631 Установка стоматологическая, вариант исполнения: INTEGO", STOM, "INTEGO"),
    ("Установка стоматологическая STOMADENT HARMONY с принадлежностями", STOM, "STOMADENT HARMONY"),
    ("Стоматологическая установка KLT, исполнения KLT-6210", STOM, "KLT-6210"),
    ("Установка стоматологическая MERCURY по ТУ 9452-001-90933304-2020", STOM, "MERCURY"),
    ("Аппарат наркозно-дыхательный WATO с принадлежностями, варианты исполнения WATO EX-35", ["Аппарат ингаляционной анестезии"], "WATO EX-35"),
    ("РЗН 2023/19677 Установка стоматологическая в вариантах исполнения:", STOM, ""),
    ("РЗН 2016/4979 (ЕРУЛ - Г004-00 Премьер 05)", STOM, "Премьер 05"),
    ("Установка стоматологическая Mercury 550", STOM, "Mercury 550"),
    ("Установка стоматологическая Mercury 550 (объект закупки является медицинским изделием, код НКМИ: 119630: Установка стоматологическая)", STOM, "Mercury 550"),
    ("Установка стоматологическая, варианты исполнения: AJ15;2010/07225", STOM, "AJ15"),
    ("Светильники медицинские АРМЕД по ТУ 9452-005-13391002-2014", LAMP, "АРМЕД"),
    ("Светильник медицинский АРМЕД по ТУ 9452-005- 13391002-2014, вариант исполнения: АРМЕД-ЛД-2 ЛЕД", LAMP, "АРМЕД-ЛД-2 ЛЕД"),
    ("Светильник бестеневой операционный «Конвелар» по ТУ 9452-016-74487176-2008 с принадлежностями: Передвижной: «Конвелар 1607ЛЭД»", LAMP, "Конвелар 1607ЛЭД"),
    ('Светильник передвижной "ЭМАЛЕД" в вариантах исполнения по ТУ 9452-015-46655261-2011', LAMP, "ЭМАЛЕД"),
    ("Б. Браун", TONO, "Б. Браун"),
    ("Б. БРАУН", TONO, "Б. БРАУН"),
    ("Измерители артериального давления и частоты пульса автоматические OMRON: М2 Basic (HEM-7121-ALRU), М2 Basic (HEM-7121-RU), М2 Basic (HEM-7121-ARU), М2 Classic (HEM-7122-ALRU), М2 Classic (HEM-7122-LRU), М3 Eco (HEM-7131-ARU), М3 Expert (HEM-7132-ALRU), М3 Family (HEM-7133-ALRU), с принадлежностями", TONO, "OMRON"),
    ("РЕНЕКС Номер регистрации товарного знака: 210801", LAMP, "РЕНЕКС"),
]


def test_designations(spark):
    schema = "n string, h array<string>"
    got = of(spark, [(n, h) for n, h, _ in GOLDEN], names.parse_name(F.col("n"), F.col("h"))["full"], schema)
    assert {n: g for (n, _, _), g in zip(GOLDEN, got, strict=True)} == {n: w for n, _, w in GOLDEN}


def test_registry_variants():
    text = "в вариантах исполнения:<br>I. Установка стоматологическая, серия Х1, вариант исполнения X1, в составе:<br>1. Светильник светодиодный навесной для серии Х1 - 1 шт.<br>II. Установка стоматологическая, серия 3, вариант исполнения X3"
    got = names.variants(text)
    assert "X1" in got and "X3" in got and not any("шт" in g or "ветильник" in g for g in got)


def test_starting_price(spark):
    cases = [([5.0, 5.0],), ([],), ([1.0, 2.0],), ([0.0],)]
    got = of(spark, cases, I.starting_price(F.col("v")), "v array<double>")
    assert [(g.value, g.note) for g in got] == [(5.0, ""), (None, ""), (None, "совместная закупка: начальных цен несколько"), (None, "")]


def test_masking(spark):
    assert of(spark, ["РУ РЗН 2020/1 и рзн 2020/1"], I.masked(F.col("v"), F.lit("РЗН 2020/1"))) == ["РУ … и …"]


def test_discount_notes(spark):
    cases = [
        ((0, 0, 3, 0, None), "торгов не было"), ((0, 0, 0, 0, None), "начальная цена неизвестна"), ((0, 1, 0, 0, 0.0), "контракт заключён по начальной цене"),
        ((0, 3, 0, 0, 0.0), "все 3 контракта — по начальной цене"), ((1, 2, 1, 0, 20.0), "снижали в 1 из 2 контрактов, максимум −20.0%; ещё 1 без торгов"),
        ((2, 21, 0, 1, 0.05), "снижали в 2 из 21 контракта, максимум −0.05%; у 1 контракта цену сравнить не с чем"),
    ]
    note = prices.discount_note(*map(F.col, "abcde"))
    assert of(spark, [c for c, _ in cases], note, "a long, b long, c long, d long, e double") == [w for _, w in cases]


def latin(text):
    return text.translate(str.maketrans(N.LOOKALIKE_CYRILLIC, N.LOOKALIKE_LATIN))


def test_type_words_and_families(spark):
    hints = F.array(F.lit("Установка стоматологическая"), F.lit(None).cast("string"))
    words = ["Облучатель-рециркулятор", "установка", "РЗН", "", "DIPLOMAT", "Бирюса", "аппараты"]
    assert of(spark, words, M.is_type_word(F.col("v"), hints)) == [True, True, True, True, False, False, True]
    assert of(spark, ["Стомат1", "Стоматологическая1", "Бирюса1", "Сто1", None], M.is_type_fragment(F.col("v"), hints)) == [True, False, False, False, False]
    pairs = [("УС", "Установка стоматологическая"), ("УС", "УС прибор"), ("KLT", "Установка"), ("ИК", "аппарат инфракрасный крупный")]
    assert of(spark, pairs, M.is_type_abbreviation(F.col("a"), F.col("b")), "a string, b string") == [True, False, False, True]
    assert of(spark, ["Бирюcа Cтол", "ABС", "Ёж"], M.mended_script(F.col("v"))) == ["Бирюса Стол", "ABC", "Ёж"]
    assert of(spark, ["Бирюса-450 x", "Mercury550", "5x", None], M.family_root(F.col("v"))) == ["бирюса", "mercury", "", ""]
    pairs = [("Бирюса 450", "Бирюса-5"), ("Mercury 5", "Merc"), ("KLT-1", "KLT-2"), ("Бирюса", "Орфей")]
    assert of(spark, pairs, M.same_family(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, False]
    assert of(spark, ["Бирюса 450S-R", "Установка DA290 x", "ab", "АРМЕД"], M.mark_keys(F.col("v"), hints)) == [[latin("бирюса450sr"), latin("бирюса"), "450sr"], [latin("установкаda290x"), "da290"], [], [latin("армед")]]


def test_marks_and_their_lists(spark):
    two, three = "a string, b string", "a string, b string, c string"
    assert of(spark, [("AJ", "AJ-15"), ("AJ", "AJax"), ("AJ", "AJ"), ("aj", "AJ 15")], M.extends(F.col("a"), F.col("b")), two) == [True, False, False, True]
    rows = [("Бирюса", "Бирюса 450S", "модели 350S; 450S"), ("Бирюса", "Бирюса 450S", "350S"), ("Бирюса", "Бирюса", "Бирюса 5"), ("a", "b", "")]
    assert of(spark, rows, M.addition_listed(F.col("a"), F.col("b"), F.col("c")), three) == [True, False, True, False]
    names_ = ["Лампа модели А1, А2", "Лампы «Луч» и «Свет»", "Лампа «Луч» по ТУ 9452-001", "Лампа KLT-1, KLT-2", "Лампа KLT-1", None]
    assert of(spark, names_, M.lists_several(F.col("v"))) == [True, True, False, True, False, False]
    assert of(spark, [("aj15", "модель AJ-15 белая"), ("aj15", "другое")], M.as_written(F.col("a"), F.col("b")), two) == ["AJ-15", "AJ15"]
    assert of(spark, ["KLT (объект закупки является медицинским изделием)", "Товарный знак: отсутствует", " «A» ,"], M.clean_trademark(F.col("v"))) == ["KLT", "", "«A»"]
    assert of(spark, ["М2 (HEM-7121), М3 (HEM-7131)", "М2 (HEM-7121)", "М2 (HEM-1), М3 (KLT-2)"], M.listed_articles(F.col("v"))) == [["HEM-7121", "HEM-7131"], [], []]
    brands = M.brand_tokens(F.array("v"), F.array(F.lit("Установка")))
    assert of(spark, ["ООО DIXION dixion «Бирюса» Luch5", "установка ABC"], brands) == [["Бирюса", "DIXION"], []]
    companies = F.array(F.lit("ООО «Диксион»"), F.lit("ARMED Ltd"))
    assert of(spark, ["Convelar Диксион 5", "Диксион 5", "Convelar", "X1 ARMED"], M.without_company_tail(F.col("v"), companies)) == ["Convelar", "Диксион 5", "Convelar", "X1"]


def test_tidy_marks(spark):
    cases = {
        "1. KLT-5": "KLT-5", "KLT-5 KLT-5": "KLT-5", "Mercury mercury 550": "Mercury 550", "KLT 5 5": "KLT 5 5", "Облучатель KLT-5": "KLT-5", "Светильник передвижной ARMED": "ARMED",
        "Облучатель": "Облучатель", "KLT-5, вариант исполнения II": "KLT-5", "KLT-5 II.": "KLT-5", "": "",
    }
    assert dict(zip(cases, of(spark, list(cases), M.tidy_mark(F.col("v"))), strict=True)) == cases
    why = {"KLT-5": None, "ООО Луч": M.IS_COMPANY, "Ромашка": M.IS_COMPANY, "": M.IS_NOTHING, "стол белый": M.IS_DESCRIPTION, "5 штук": M.IS_DESCRIPTION, "302 мм": M.IS_MEASURE, "Россия": M.IS_COUNTRY, "A, B, C": M.IS_LIST, "A (B": M.IS_LIST}
    assert dict(zip(why, of(spark, list(why), M.why_no_mark(F.col("v"), F.lit("ромашка"))), strict=True)) == why
    assert of(spark, ["масса не более 5", "Есть: ДА Цвет", "KLT", "a: b: c: " + "x" * 120], M.spec_sheet(F.col("v"))) == [True, True, False, True]
    assert of(spark, ["Действует", " действующее", "Отменён", None], M.is_active(F.col("v"))) == [True, True, False, False]


def test_captions(spark):
    assert of(spark, ["Стол операционный, белый / малый", "Аппарат искусственной вентиляции лёгких"], M.name_variants(F.col("v"))) == [
        ["Стол операционный, белый / малый", "Стол операционный, белый", "Стол операционный"], ["Аппарат искусственной вентиляции лёгких", "аппарат искусственной"],
    ]
    assert of(spark, ["a; B\nA;; c", None], M.lines(F.col("v"))) == [["a", "B", "c"], []]
    days = [("01.02.2024", "2024-02-02"), ("03.02.2024", "02.03.2024"), ("02.02.2024", "02.02.2024"), ("x", "02.02.2024")]
    assert of(spark, days, M.earlier(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, False]
    values = [("есть", None, None, None, "ММ"), (None, "5", None, None, "ММ"), (None, None, "> 1", "3", "К"), (None, None, "1", " ", None), ("", "", "", "7", "кг"), (None, None, None, None, "ММ")]
    assert of(spark, values, M.value_text(*map(F.col, "abcde")), "a string, b string, c string, d string, e string") == ["есть", "5 мм", "> 1–3 К", "от 1", "до 7 кг", ""]
    times = {10.0: "меньше минуты", 60.0: "около минуты", 240.0: "около 4 минут", 21 * 60.0: "около 21 минуты", 3600.0: "около часа", 2 * 3600 + 30 * 60.0: "около 2 часов 30 мин", 21 * 3600.0: "около 21 часа"}
    assert of(spark, [(t,) for t in times], M.duration(F.col("v")), "v double") == list(times.values())
    assert of(spark, ["32.50.13.110-00001", "рускан 70п?", None], M.report_name(F.col("v"), F.lit("2024-01-02 03:04:05").cast("timestamp"))) == ["медизделия_32_50_13_110-00001_20240102_030405", "медизделия_рускан_70п_20240102_030405", "медизделия_папка_20240102_030405"]
    assert of(spark, [("", "file"), (" 1 ", "file"), (None, None)], M.contract_key(F.col("a"), F.col("b")), "a string, b string") == ["file", "1", None]
