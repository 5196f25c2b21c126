"""Domain cases of the operators, and sources."""

from pyspark.sql import functions as F

from lotwright.functions import normalise as N
from lotwright.operators import canon, ranking, resolve, rollups, select
from lotwright.sources import contract_xml, pages
from lotwright.streaming import progress

POSITION = "Установка стоматологическая"
ONE = "Установка стоматологическая, вариант исполнения: AJ15"
ALL = "Установка стоматологическая, варианты исполнения: AJ11, AJ12, AJ15, AJ16, AJ18"


def test_verdicts(spark):
    cases = [
        ("Ajax AJ15", POSITION, ONE, "", (True, "бренд")),
        ("Ajax AJ15", POSITION + " Товарный знак: Ajax", ONE, "", (True, "")),
        ("Ajax AJ15", POSITION + " Товарный знак: AJAX", ALL, "", (True, "исполнение")),
        ("Ajax AJ18", POSITION, ONE, "", (False, "")),
        ("Ajax AJ15", POSITION + " Товарный знак: AJ11", ALL, "", (False, "")),
        ("Ajax AJ15", POSITION + " Товарный знак: Ajax AJ15", ALL, "", (True, "")),
        ("Ajax AJ15", POSITION, ONE, "Guangzhou Ajax Medical Equipment Co., Ltd.", (True, "")),
        ("Olympus CV170", POSITION, "Видеосистема CV-170", "Guangzhou Ajax Medical Equipment", (True, "бренд")),
        ("рускан 70п", "Система ультразвуковая", "Аппарат ЭГД-70П", "", (False, "")),
        ("рускан 70п", "Система ультразвуковая РуСкан 70П", "", "", (True, "")),
        ("рускан", "Система ультразвуковая РуСкан 60", "", "", (True, "")),
        ("", POSITION, "", "", (False, "")),
    ]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, q string, c string, f string, k string")
    got = frame.select("i", select.judge(*map(F.col, "qcfk")).alias("v")).orderBy("i").collect()
    assert [(r.v.ok, r.v.doubt) for r in got] == [c[4] for c in cases]
    best = frame.limit(1).select(select.judge_any(["Olympus", "Ajax AJ15", "Ajax"], F.lit(POSITION + " Товарный знак: Ajax"), F.lit(ONE), F.lit("")).alias("v")).first().v
    assert best.ok and best.doubt == ""


def test_collect_rows_rescues_names_only_beside_a_match(spark):
    rows = [(1, "A", "Стол "), (1, None, "стол"), (1, None, "стул"), (2, None, "стол"), (3, "B", "стол")]
    got = select.collect_rows(spark.createDataFrame(rows, "contract int, ktru string, name string"), ["A"], "contract")
    assert sorted((r.contract, r.name, r.by) for r in got.collect()) == [(1, "Стол ", "code"), (1, "стол", "name")]


def test_collected_by_text_number_and_code(spark):
    """Text alone, number alone, code and text, no filter; services go where asked."""
    columns = "contract int, name string, ktru string, ktru_name string, trademark string, mark string, specs_text string, ru_name string, ru_variants string, ru_number string"
    rows = [
        (1, "Установка", "A", "Установка", "Ajax AJ15", None, None, "Установка РЗН 2016/4964", None, None),
        (1, "Установка", None, None, None, None, "модель AJ15", None, None, "R 1"),
        (2, "Ремонт: Ajax AJ15", "A", None, None, None, None, None, None, None),
        (3, "Стол", "B", None, None, None, None, None, "AJ11, AJ15", None),
    ]
    frame = spark.createDataFrame(rows, columns)

    def got(**asked):
        found, counts = select.collected(frame, **asked)
        return sorted((r.contract, r.by, r.ru_number, r.doubt) for r in found.collect()), counts.first().asDict()

    found, counts = got(phrases=["Ajax AJ15"])
    assert found == [(1, "all", "R 1", "бренд"), (1, "all", "РЗН 2016/4964", ""), (2, "all", None, ""), (3, "all", None, "исполнение")]
    assert (counts["rows"], counts["listed_only"], counts["brand_unnamed"], counts["off_query"], counts["filtered"]) == (4, 1, 1, 0, 0)
    found, counts = got(codes=["A"], phrases=["AJ15", " "], drop_services=True)
    assert found == [(1, "code", "РЗН 2016/4964", ""), (1, "name", "R 1", "")]
    assert (counts["filtered"], counts["without_code"], counts["by_name"], counts["contracts_without"], counts["services"], counts["rows"]) == (2, 1, 1, 1, 1, 2)
    assert [r[0] for r in got(registrations=["4964"])[0]] == [1]
    assert len(got()[0]) == 4 and got(codes=["Z"])[1]["contracts_without"] == 3


def test_plan():
    s = select.Search(codes=["1"], registrations=["R"], phrases=["x y", "X"])
    assert select.plan(s) == [("code", "1"), ("registration", "R"), ("word", "x"), ("word", "y")]
    assert select.plan(select.Search(codes=["1"], phrases=["x"], only_codes=True)) == [("code", "1")]


def test_transfer_needs_agreement(spark):
    rows = [("n1", "ООО Альфа", 1), ("n1", "Альфа", 2), ("n1", None, 3), ("n2", "Альфа", 4), ("n2", "Бета", 5), ("n2", None, 6), ("n3", None, 7)]
    frame = spark.createDataFrame(rows, "k string, m string, pos int")
    donors = resolve.unanimous(frame, ["k"], "m", N.producer_key(F.col("m")), "pos")
    got = {r.pos: (r.filled, r.source, r.conflict) for r in resolve.fill(frame, donors, ["k"], "m").collect()}
    assert got[3] == ("ООО Альфа", "donor", False) and got[6] == (None, "none", True) and got[7] == (None, "none", False)


def test_cascade_falls_through_ambiguous_keys(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "ru string, tu string")
    held = spark.createDataFrame([("a", "x", "P"), ("b", "q", "P"), ("b", "q", "R"), ("d", "x", "P")], "no string, spec string, producer string")
    got = resolve.registry_cascade(asked, held, [("ru", "no"), ("tu", "spec")], "producer", F.col("producer"))
    assert {r.ru: (r.producer, r.found_by) for r in got.collect()} == {"a": ("P", "ru"), "b": ("P", "tu"), "c": (None, None)}


def test_marks_extend_once(spark):
    rows = [("r1", "Mercury"), ("r1", "Mercury 550"), ("r2", "Ajax"), ("r2", "Ajax 1"), ("r2", "Ajax 2"), ("r3", "Meta"), ("r3", "Metalux")]
    got = resolve.extend_marks(spark.createDataFrame(rows, "n string, m string"), "n", "m")
    assert {(r.n, r.m): r.extended for r in got.collect()}[("r1", "Mercury")] == "Mercury 550"
    assert {(r.n, r.m): r.extended for r in got.collect()}[("r2", "Ajax")] == "Ajax"
    assert {(r.n, r.m): r.extended for r in got.collect()}[("r3", "Meta")] == "Meta"


def test_two_hop(spark):
    edges = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3)], "n string, v int")
    assert sorted(r.n for r in resolve.two_hop(edges, spark.createDataFrame([("a",)], "n string"), "n", "v").collect()) == ["a", "b"]


def test_groups_of_users():
    groups = canon.merge_groups({}, ["Альфа", "ООО АЛЬФА", "Alfa"])
    assert groups == {"Альфа": ["Alfa", "Альфа"]}
    groups = canon.merge_groups(groups, ["Бета", "alfa"], "Новая")
    assert list(groups) == ["Новая"] and sorted(groups["Новая"]) == ["alfa", "Альфа", "Бета"]
    assert canon.split_groups(groups, ["Alfa", "Бета"]) == {}
    assert canon.rename_group(groups, "Новая", "Иная") == {"Иная": groups["Новая"]}
    assert canon.rename_group(groups, "нет", "Иная") is groups


def test_group_table_meets_the_column_key(spark):
    table = canon.group_table(spark, {"T": ["ООО «Вектор-М»"]})
    names = spark.createDataFrame([("Вектор М",), ("вектор-м",), ("Иной",)], "name string")
    got = canon.assign_groups(names, "name", N.group_key(F.col("name")), table)
    assert {r.name: r.title for r in got.collect()} == {"Вектор М": "T", "вектор-м": "T", "Иной": "Иной"}


def test_discounts(spark):
    rows = [("s", "—", 20.0, ""), ("s", "—", 0.0, ""), ("s", "торгов не было", None, "")]
    got = rollups.discount_stats(spark.createDataFrame(rows, "stage string, bidding string, percent double, why string"), ["stage"]).first()
    assert (got.median_pct, got.known, got.no_bidding, got.contracts, got.lowered) == (20.0, 2, 1, 3, 1)


def test_gate(spark):
    rows = [("a", 1)] * 9 + [("a", 0)] * 3 + [("b", 1)] * 12
    got = {r.g: (r.blocked, r.stop_all) for r in rollups.calibration_gate(spark.createDataFrame(rows, "g string, right int"), "g").collect()}
    assert got == {"a": (True, True), "b": (False, True)}


def test_ranking_ties_keep_the_first(spark):
    rows = [("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4)]
    frame = spark.createDataFrame(rows, "k string, v string, pos int")
    assert ranking.most_common(frame, ["k"], "v", "pos").first() == ("k", "b", 2)
    assert ranking.first_wins(frame, ["k"], [F.col("pos")]).first().pos == 1
    assert ranking.last_wins(frame, ["k"], ["pos"]).first().pos == 4
    gone = ranking.evicted(frame.withColumn("size", F.lit(10)), ["k"], "size", ["pos"], 30, 0.5)
    assert sorted(r.pos for r in gone.collect()) == [1, 2, 3]


XML = """<ns2:export xmlns:ns2="u"><ns2:contract><ns2:regNum>1234567890123456789</ns2:regNum><ns2:signDate>2025-02-03T00:00:00</ns2:signDate>
<ns2:priceInfo><ns2:price>300.50</ns2:price></ns2:priceInfo>
<ns2:supplierInfo><ns2:individualPerson><ns2:lastName>ИВАНОВ</ns2:lastName><ns2:firstName>ИВАН</ns2:firstName><ns2:isIP>true</ns2:isIP></ns2:individualPerson></ns2:supplierInfo>
<ns2:products><ns2:productInfo><ns2:name>Стол</ns2:name><ns2:KTRUInfo><ns2:code>32.50.13.190-00007</ns2:code></ns2:KTRUInfo><ns2:price>100,25</ns2:price><ns2:quantity>2</ns2:quantity></ns2:productInfo>
<ns2:productInfo><ns2:KTRUInfo><ns2:name>Стул</ns2:name></ns2:KTRUInfo><ns2:price>5</ns2:price><ns2:quantity>20</ns2:quantity><ns2:sum>99</ns2:sum></ns2:productInfo></ns2:products></ns2:contract></ns2:export>"""


def test_contract_xml(spark):
    docs = spark.createDataFrame([(XML,)], "xml string")
    head = contract_xml.header(docs, "xml").first()
    assert (head.reestr_number, str(head.conclusion_date), head.contract_price, head.supplier) == ("1234567890123456789", "2025-02-03", 300.5, "ИП Иванов Иван")
    got = [(r.line, r.name, r.ktru, r.price, r.quantity, r.total) for r in contract_xml.positions(docs, "xml").orderBy("line").collect()]
    assert got == [(0, "Стол", "32.50.13.190-00007", 100.25, 2.0, 200.5), (1, "Стул", None, 5.0, 20.0, 99.0)]


def test_contract_xml_reads_a_product_once(spark, capsys):
    """Comments, character data, empty, repeated and nested elements; one parse a product."""
    odd = """<e><!-- <regNum>x</regNum> --><regNum/><b><regNum><![CDATA[7&8]]></regNum></b><productInfo><name/><KTRUInfo><name>k &#1080; &lt;</name></KTRUInfo><KTRUInfo><code>c2</code></KTRUInfo><foo><price>9</price></foo><price></price><price cur="R">5</price></productInfo><productInfo/></e>"""
    read = contract_xml.positions(spark.createDataFrame([(odd,), (None,), ("<e><productInfo/></e>",)], "xml string"), "xml")
    assert [tuple(r) for r in read.collect()] == [("7&8", 0, "k и <", "c2", 5.0, None, None)]
    read.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_xml") == 1 and "productInfo/name" not in plan


def test_specs(spark):
    frame = spark.sql("SELECT array(named_struct('name', 'Цвет: ', 'value', 'белый'), named_struct('name', 'цвет', 'value', 'x'), named_struct('name', 'Вес', 'value', ' ')) AS s")
    assert frame.select(contract_xml.specs_text(F.col("s")).alias("t")).first().t == "Цвет: белый"


FORM = """<table><tr><td>x</td></tr></table><table><tr><th>№</th><th>Наименование товара</th><th>КТРУ</th><th>Количество</th><th>Цена за единицу</th><th>Сумма</th></tr>
<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr>
<tr><td>1</td><td>Стол &laquo;А&raquo;</td><td>32.50</td><td>2 шт</td><td>1 000,50</td><td></td></tr></table>"""


def test_print_form(spark):
    got = spark.createDataFrame([(FORM,), (None,)], "html string").select(F.explode(pages.print_form(F.col("html"))).alias("p")).select("p.*").collect()
    assert [(r.name, r.quantity, r.unit, r.price, r.total) for r in got] == [("Стол «А»", 2.0, "шт", 1000.5, 2001.0)]


def test_search_hits(spark):
    html = '<div class="search-registry-entry-block">№ 1234567890123456789 <b>Цена</b> 1 234,50 ₽ 01.02.2025</div><div class="search-registry-entry-block">nothing</div>'
    got = spark.createDataFrame([(html,)], "html string").select(F.explode(pages.search_hits(F.col("html"))).alias("h")).select("h.*").collect()
    assert [(r.reestr_number, r.price, r.concluded) for r in got] == [("1234567890123456789", 1234.5, "01.02.2025")]


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], 1.0) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    source = progress.stream(spark, f"file://{tmp_path}/in/*", events.schema)
    query = progress.hourly(source).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, progress.hourly(events).collect()))
    assert {r.user_id: r.event_id for r in progress.latest(events.union(events)).collect()} == {0: 57, 1: 58, 2: 59}
