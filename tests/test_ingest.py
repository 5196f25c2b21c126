"""Products, contracts from stored documents, and catalogue cards."""

from pyspark.sql import functions as F

from lotwright.sources import cards, ingest, pages, products

XML = """<?xml version="1.0" encoding="UTF-8"?>
<ns3:export xmlns:ns3="u" xmlns="v"><!-- <productInfo><name>нет</name></productInfo> --><ns3:contract>
<ns3:productInfo><indexNum>7</indexNum><KTRUInfo><code>26.60.12.119-00000205</code><name>Аппарат</name></KTRUInfo><OKPD2Info><OKPDCode>26.60</OKPDCode></OKPD2Info>
<name>Аппарат &lt;ультразвуковой&gt; &amp;amp;</name><OKEIInfo><nationalCode>ШТ</nationalCode></OKEIInfo><quantity>2</quantity><price>1 000,50</price>
<medicalProductInfo><isMedicalProductInfo>TRUE</isMedicalProductInfo><medicalProductCode>123450</medicalProductCode><medicalProductName>Вид</medicalProductName><certificateNameMedicalProduct>РУ имя</certificateNameMedicalProduct></medicalProductInfo>
<characteristics><characteristicsUsingReferenceInfo><name>Источник света:</name><values><value><qualityDescription>Галогенная</qualityDescription></value><value><qualityDescription>Диодная</qualityDescription></value></values></characteristicsUsingReferenceInfo>
<characteristicsUsingReferenceInfo><name>Длина</name><values><value><OKEI><nationalCode>ММ</nationalCode></OKEI><rangeSet><valueRange><minMathNotation>greater</minMathNotation><min>5</min><maxMathNotation>lessOrEqual</maxMathNotation><max>9</max></valueRange></rangeSet></value></values></characteristicsUsingReferenceInfo>
<characteristicsUsingTextForm><name>Масса</name><values><value><OKEI><name>К</name></OKEI><valueSet><concreteValue>3</concreteValue></valueSet></value></values></characteristicsUsingTextForm>
<characteristicsUsingTextForm><name>масса;</name><values><value><qualityDescription>вторая</qualityDescription></value></values></characteristicsUsingTextForm></characteristics>
<VATRateInfo><VATCode>NO</VATCode></VATRateInfo><originCountryInfo><countryFullName>Россия</countryFullName></originCountryInfo><tradeMark>Ajax AJ15</tradeMark></ns3:productInfo>
<ns3:productInfo><KTRUInfo><code>1</code><name>Зонд</name></KTRUInfo><sum>10</sum><tradeMark>отсутствует</tradeMark></ns3:productInfo></ns3:contract></ns3:export>"""
OLD = "<c><product><name>Стол</name><price>5</price></product><product><name>без цены</name></product></c>"
FORM = "<table><tr><th>№</th><th>Наименование товара</th><th>Количество</th><th>Единица измерения</th><th>Цена</th></tr><tr><td>1</td><td>Лампа</td><td>2</td><td>шт</td><td>3,50</td></tr></table>"


def test_products(spark):
    rows = products.products(spark.createDataFrame([("a", XML)], "contract string, x string"), ["contract"], "x").orderBy("line").collect()
    two, one = rows
    assert (one.line, one.name, one.ktru, one.ktru_name, one.okpd2) == (7, "Аппарат <ультразвуковой> &amp;", "26.60.12.119-00000205", "Аппарат", "26.60")
    assert (one.is_medical, one.nkmi, one.nkmi_name, one.ru_name, one.unit) == (True, "123450", "Вид", "РУ имя", "ШТ")
    assert (one.quantity, one.price, one.total, one.vat, one.country, one.trademark) == (2.0, 1000.5, 2001.0, "NO", "Россия", "Ajax AJ15")
    assert [tuple(s) for s in one.specs] == [("Источник света", "Галогенная, Диодная"), ("Длина", "> 5–9 мм"), ("Масса", "3 К")]
    assert one.specs_text == "Источник света: Галогенная, Диодная; Длина: > 5–9 мм; Масса: 3 К"
    assert (two.line, two.name, two.ktru, two.total, two.trademark, two.is_medical, two.specs) == (2, "Зонд", "1", 10.0, None, False, [])


def test_products_read_a_value_once(spark, capsys):
    """Parts of a characteristic are looked for once, however often they are spoken of."""
    products.products(spark.createDataFrame([("a", XML)], "contract string, x string"), ["contract"], "x").explain(mode="extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    for part in ("qualityDescription", "concreteValue", "minMathNotation", "OKEI", "valueRange"):
        assert optimized.count(f"<{part}(") == 1, part


def test_broken_and_old_documents(spark):
    texts = [XML, OLD, XML[:900], "", None, "просто текст", "<a>&bad;</a>", "<a/>"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", products.well_formed(F.col("x")).alias("fit"), F.size(products.product_nodes(F.col("x"))).alias("n")).orderBy("i").collect()
    assert [r.fit for r in got] == [True, True, False, False, False, False, False, True]
    assert [r.n for r in got if r.fit] == [2, 1, 0]


def test_ingest(spark):
    contracts = spark.createDataFrame([(i,) for i in range(7)], "contract int")
    files = [
        (0, "Контракт 1.xml", OLD), (0, "Электронный контракт 1.xml (12,5 КБ)", XML), (1, "Контракт 1.xml", XML[:900]), (2, "Контракт 2.xml", "<a/>"), (3, "Счёт 3.xml", XML),
        (4, "Контракт 4.xml", "<a>"), (5, "Контракт с учётом доп. соглашений 1.xml", OLD), (9, "Контракт 9.xml", XML),
    ]
    forms = [(1, FORM), (2, "<p>пусто</p>"), (3, FORM), (0, FORM)]
    rows, problems = ingest.load(contracts, spark.createDataFrame(files, "contract int, file string, body string"), spark.createDataFrame(forms, "contract int, html string"))
    got = sorted((r.contract, r.source, r.amended, r.line, r.name, r.total) for r in rows.collect())
    assert got == [(0, "eis-xml", False, 2, "Зонд", 10.0), (0, "eis-xml", False, 7, "Аппарат <ультразвуковой> &amp;", 2001.0), (1, "eis-html", False, 1, "Лампа", 7.0), (3, "eis-html", False, 1, "Лампа", 7.0), (5, "eis-xml", True, 1, "Стол", None)]
    assert sorted(map(tuple, problems.collect())) == [(2, "разбор", "в XML нет позиций объекта закупки; в печатной форме нет позиций"), (4, "загрузка", "XML не разобран; печатной формы нет"), (6, "загрузка", "нет файла контракта; печатной формы нет")]


PAGE = """<html><body><div class="search-registry-entry-block box"><div class="registry-entry__header-mid__number"><a> 26.60.12.119-00000205 </a></div><br>
<div class="registry-entry__header-mid__h4">Аппарат&nbsp;<span class="hl">ультра</span>звуковой</div><div>Позиция <b>КТРУ</b></div><div>Позиция КТРУ</div><div>Единица измерения: штука</div>
<div>Включено в каталог</div><div>01.02.2020</div><script>var x = "Исключено 01.01.1999";</script></div>
<div class="search-registry-entry-block"><div class="registry-entry__header-mid__number">1</div><p>Вторая<p>строка<div>Исключено <span>03.04.2021</span></div></div><div>Исключено 05.05.2005 Единица измерения: вне</div></body></html>"""


def test_cards(spark):
    old = '<div class="registry-entry"><i>номер</i><div>Единица измерения: пара</div><div>Имя</div></div>'
    rows = spark.createDataFrame([(0, PAGE), (1, old), (2, ""), (3, None), (4, "<div class='search-registry-entry-block'>")], "i int, h string").select("i", F.explode(cards.cards("h")).alias("c")).select("i", "c.*")
    got = [tuple(r) for r in rows.orderBy("i", F.desc("code")).collect()]
    assert got == [
        (0, "26.60.12.119-00000205", "Аппарат ультразвуковой", "штука", "", "01.02.2020", True), (0, "1", "Вторая", "", "03.04.2021", "", False),
        (1, "", "Имя", "пара", "", "", False), (4, "", "", "", "", "", False),
    ]


def test_plain_forms_read_as_by_the_parser():
    """Tables without other tags are cut by pattern; the rest goes to the parser, and both give the same cells."""
    plain = [
        FORM, FORM.upper(), "<table><tr><td>a &amp; b&nbsp;c&lt;</td ><td class='x y' width=10>\n d</td>", "<td>x</td><tr><table><tr><td>1<td>2</td></tr></table>", "", "text", "<table><tr><td>open",
        '<table border="1"><tr><th>A</th>tail<td>&copy b</td></tr><tr></tr></table><table></table>',
    ]
    odd = ["<table><tr><td>a<br>b</td></tr>", "<table><!-- <tr> --><tr><td>a < b</td></tr>", "<table><tr><td title='a>b'>c</td><td/></tr>", "<table><tr><td><script><td></script>x</td></tr>"]
    for html in plain + odd:
        reader = pages._Tables()
        reader.feed(html)
        cut = pages._plain_tables(html)
        assert (cut is None) == (html in odd), html
        assert pages._tables(html) == reader.tables, html


def test_forms_of_a_batch(spark):
    frame = spark.createDataFrame([(0, FORM), (1, None), (2, ""), (3, FORM.replace("</table>", "<tr><td>2</td><td>Зонд</td><td>3 уп</td><td></td><td>нет</td></tr></table>"))], "i int, html string")
    got = [tuple(r) for r in frame.select("i", F.posexplode(pages.print_form("html")).alias("at", "p")).select("i", "at", "p.*").orderBy("i", "at").collect()]
    lamp = ("Лампа", None, 2.0, "шт", 3.5, 7.0)
    assert got == [(0, 0, *lamp), (3, 0, *lamp), (3, 1, "Зонд", None, 3.0, "уп", None, None)]
