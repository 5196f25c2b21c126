"""Queries that judge names, numbers and designations against each other and against the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import companies as C
from ..functions import evidence as E
from ..functions import identifiers as I
from ..functions import normalise as N
from ..operators import resolve
from ..sources.tables import table
from .bindings import POSITION_SQL, positions

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _text(*parts):
    """Columns and literal strings, one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: How a company's name may be written, beside what it says.
DRESSED = ("{}", '"{}"', "«{}», Китай", "{}, Российская Федерация", "{} / Россия", "{} Германия (276)", " {} ,;", "{}, Республика Беларусь.")


@query("op.clean_company", "SELECT s_suppkey, s_name AS company FROM supplier")
def clean_company(spark, sf_dir):
    """Suppliers' names in every dress, undressed."""
    forms = F.array(*[F.lit(d) for d in DRESSED])
    dressed = F.replace(F.get(forms, (F.col("s_suppkey") % len(DRESSED)).cast("int")), F.lit("{}"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.clean_company(dressed).alias("company"))


@query("op.company_keys", """
SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS outside, 'заводлуч' || s_nationkey AS inside FROM supplier
""")
def company_keys(spark, sf_dir):
    keys = C.company_keys(_text("ООО «", F.col("s_name"), "» Ltd (АО Завод Луч ", F.col("s_nationkey"), ") (ИП Ли)"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", keys.alias("k")).select("s_suppkey", F.get("k", F.lit(0)).alias("outside"), F.get("k", F.lit(1)).alias("inside"))


@query("op.same_company", """
SELECT s_suppkey, s_suppkey % 6 IN (0, 1, 2, 3) AS same FROM supplier
""")
def same_company(spark, sf_dir):
    kind, name = F.col("s_suppkey") % 6, F.col("s_name")
    other = (
        F.when(kind == 0, _text("ООО «", name, "»")).when(kind == 1, _text(name, " Франция")).when(kind == 2, _text(name, " Ltd"))
        .when(kind == 3, F.lit("ДЗМО")).when(kind == 4, _text(name, " плюс")).otherwise(F.lit(""))
    )
    mine = F.when(kind == 3, F.lit("Досчатинский завод медицинского оборудования")).otherwise(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.same_company(mine, other).alias("same"))


@query("op.is_company_name", "SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 2) AS company FROM supplier")
def is_company_name(spark, sf_dir):
    kind, name = F.col("s_suppkey") % 5, F.col("s_name")
    value = F.when(kind == 0, _text("ООО ", name)).when(kind == 1, _text(name, " GmbH")).when(kind == 2, name).when(kind == 3, name).otherwise(_text("Китай, ООО ", name))
    source = F.when(kind == 2, _text("Изготовитель: ", name, ", Омск")).otherwise(_text("Модель: ", name))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.is_company_name(value, source).alias("company"))


@query("op.mended_form", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ИП ' || s_name ELSE 'ИП' END AS declarant FROM supplier")
def mended_form(spark, sf_dir):
    kind = F.col("s_suppkey") % 3
    maker = F.when(kind == 1, _text("ООО ", F.col("s_name"))).otherwise(_text("ИП ", F.col("s_name")))
    place = F.when(kind == 2, "Томск").otherwise("Омск")
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.mended_form(F.lit("ИП"), maker, (F.lit(""), F.lit("")), (F.lit("Омск"), place)).alias("declarant"))


@query("op.same_device_kind", """
SELECT p_partkey, p_size % 4 <> 3 AS same FROM part
""")
def same_device_kind(spark, sf_dir):
    kinds = F.array(F.lit("Аппарат для измерения артериального давления электрический с ручным нагнетением"), _text("Изделие ", F.col("p_name")))
    kind = F.col("p_size") % 4
    said = (
        F.when(kind == 0, _text("Прибор для измерения артериального давления ", F.col("p_brand"))).when(kind == 1, F.lit("Измеритель артериального давления и пульса"))
        .when(kind == 2, _text("Изделия ", F.col("p_name"), " прочие")).otherwise(F.lit("Стол операционный"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", E.same_device_kind(said, kinds).alias("same"))


@query("op.shares_mark", "SELECT p_partkey, p_size % 3 <> 2 AS shared FROM part")
def shares_mark(spark, sf_dir):
    kind = F.col("p_size") % 3
    record = F.when(kind == 0, _text("Камеры холодильные ", F.upper("p_type"), " медицинские")).when(kind == 1, _text("Камера медицинская для крови, серия 5")).otherwise("Стол")
    name = F.when(kind == 1, F.lit("Камера медицинская для крови")).otherwise(_text('Камера "', F.upper("p_type"), " ", F.col("p_partkey"), '"'))
    return table(spark, sf_dir, "part").select("p_partkey", E.shares_mark(name, record).alias("shared"))


@query("op.contradicts", "SELECT p_partkey, p_size % 4 = 1 AS contradicts FROM part")
def contradicts(spark, sf_dir):
    kind, number = F.col("p_size") % 4, (1000 + F.col("p_partkey") % 8000)
    said = _text("Аппарат по ТУ 9452-001-90933304-2020 KLT-", number)
    record = F.when(kind == 0, _text("Аппараты КLТ - ", number, "A, KLT-9999")).when(kind == 1, _text("Аппарат KLT-", number + 1)).when(kind == 2, F.lit("Аппарат")).otherwise(_text("Аппарат ABC-", number))
    return table(spark, sf_dir, "part").select("p_partkey", E.contradicts(said, record).alias("contradicts"))


@query("op.evidence", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ',' || p_type WHEN p_size % 3 = 1 THEN p_type ELSE '' END AS evidence FROM part
""")
def evidence(spark, sf_dir):
    kind = F.col("p_size") % 3
    record = F.when(kind == 0, _text("Завод ", F.col("p_brand"), " модель ", F.lower("p_type"))).when(kind == 1, _text(F.col("p_type"), " KLT-5555")).otherwise(_text(F.col("p_brand"), " ", F.col("p_type"), " KLT-7777"))
    said = F.when(kind == 2, "аппарат KLT-5555").otherwise("аппарат")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.evidence(F.array("p_brand", "p_type"), said, record), ",").alias("evidence"))


@query("op.keep_same_number", "SELECT p_partkey, p_size % 3 <> 2 AS kept FROM part")
def keep_same_number(spark, sf_dir):
    kind, number = F.col("p_size") % 3, F.col("p_partkey")
    held = F.when(kind == 0, _text("рзн  2020 / ", number)).when(kind == 1, F.lit("")).otherwise(_text("РЗН 2020/", number, "1"))
    unified = F.when(kind == 1, _text("РЗН2020/", number)).otherwise("Г004-1")
    return table(spark, sf_dir, "part").select("p_partkey", E.same_number(_text("РЗН 2020/", number), held, unified).alias("kept"))


@query("op.phrase_matches", """
SELECT p_partkey, contains(lower(p_name), 'widget') AND contains(p_type, 'PROMO') AS phrase, contains(lower(p_name), 'widget') AND contains(p_type, 'PROMO') OR contains(p_name, 'red') AS any FROM part
""")
def phrase_matches(spark, sf_dir):
    text = _text(F.col("p_name"), " / ", F.col("p_type"))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", E.phrase_matches(F.lit("видгет, ПРОМО"), text).alias("phrase"), E.any_match(F.array(F.lit("видгет промо"), F.lit("Red"), F.lit("")), text).alias("any"))


@query("op.variant_supported", "SELECT p_partkey, p_size % 3 = 0 AS supported FROM part")
def variant_supported(spark, sf_dir):
    kind, size = F.col("p_size") % 3, F.col("p_size")
    quote = F.when(kind == 0, _text("модель DA-", size, " белая")).when(kind == 1, F.lit("модель белая")).otherwise(_text("кресло зелёное DA-", size))
    return table(spark, sf_dir, "part").select("p_partkey", E.variant_supported(_text("DA ", size), quote, _text("Стул, модель DA-", size, " белая")).alias("supported"))


@query("op.parse_reply", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def parse_reply(spark, sf_dir):
    """A reply's object between fences and talk, with a brace inside a text."""
    raw = _text('Ответ:\n```json\n{"kind": "', F.col("event_type"), '", "quote": "a {b} \\"c\\"", "who": ', F.col("user_id"), "}\n``` и ещё {\"kind\": \"другое\"}")
    return table(spark, sf_dir, "events").select("event_id", E.reply_fields(raw).alias("r")).select("event_id", F.col("r")["kind"].alias("kind"), F.col("r")["who"].alias("who"))


@query("op.is_trademark", "SELECT p_partkey, p_size % 6 IN (0, 1) AS real FROM part")
def is_trademark(spark, sf_dir):
    kind = F.col("p_size") % 6
    value = (
        F.when(kind == 0, F.upper("p_type")).when(kind == 1, _text("«", F.col("p_name"), "»")).when(kind == 2, "отсутствует").when(kind == 3, _text("№ ", F.col("p_partkey")))
        .when(kind == 4, "нет").otherwise("масса: 5, кг")
    )
    return table(spark, sf_dir, "part").select("p_partkey", I.is_trademark(value).alias("real"))


@query("op.is_measure", "SELECT p_partkey, p_size % 4 IN (0, 1) AS measure FROM part")
def is_measure(spark, sf_dir):
    kind, size = F.col("p_size") % 4, F.col("p_size")
    value = F.when(kind == 0, _text("d=", size, "мм")).when(kind == 1, _text(size, ",5 см")).when(kind == 2, _text("30-", size, "-00")).otherwise(size.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", I.is_measure(value).alias("measure"))


@query("op.main_registration", "SELECT p_partkey, 'РЗН 2018/' || (1000 + p_size) AS main FROM part")
def main_registration(spark, sf_dir):
    text = _text("Компрессор ", F.col("p_brand"), " по РУ ФСЗ 2009/", 100 + F.col("p_partkey"), " и Аппарат ингаляционного наркоза по РУ РЗН 2018/", 1000 + F.col("p_size"), " с принадлежностями")
    return table(spark, sf_dir, "part").select("p_partkey", I.main_registration(text, F.lit("Аппарат для ингаляционного наркоза")).alias("main"))


@query("op.mask_number", "SELECT p_partkey, 'РУ … и … рядом' AS masked FROM part")
def mask_number(spark, sf_dir):
    number = _text("РЗН 2020/", F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", I.masked(_text("РУ ", number, " и ", F.lower(number), " рядом"), number).alias("masked"))


@query("op.drop_holder", f"""
WITH {POSITION_SQL} SELECT contract, line, inn, total, CASE WHEN line % 2 = 0 OR line = 1 THEN declarant END AS holder FROM positions
""")
def drop_holder(spark, sf_dir):
    """A position without a registration number has a maker, but no holder of a registration."""
    number = F.when(F.col("line") % 2 == 0, F.col("ru_number").cast("string")).otherwise(" ")
    maker = F.when(F.col("line") != 1, F.col("manufacturer"))
    return positions(spark, sf_dir).select("contract", "line", "inn", "total", resolve.holder_with_number(maker, F.col("declarant"), number).alias("holder"))


@query("op.purchase_numbers", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS number FROM orders")
def purchase_numbers(spark, sf_dir):
    number = F.lpad(F.col("o_orderkey").cast("string"), 19, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", I.purchase_number(_text("№ ", F.left(number, F.lit(5)), " ", F.substring(number, 6, 14), "/77")).alias("number"))
