"""Queries over marks: tidied, dropped, filled, spelled alike; and over captions and forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as M
from ..operators import marks, rollups
from ..sources import pages as P
from ..sources import reports as R
from ..sources.tables import table
from .bindings import CONTRACT_SQL, POSITION_SQL, contracts, positions
from .judging import _text

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


MARK_SQL = f"""
WITH {POSITION_SQL}, m AS (
  SELECT contract, line, inn, total, manufacturer, 'KLT-' || (100 + ru_number % 7) AS good,
         CASE line WHEN 1 THEN '1. KLT-' || (100 + ru_number % 7) WHEN 2 THEN 'Облучатель KLT-' || (100 + ru_number % 7) WHEN 3 THEN 'ООО Луч' WHEN 4 THEN '302 мм' WHEN 5 THEN 'Россия' WHEN 6 THEN 'стол белый' ELSE manufacturer END AS original
  FROM positions)
"""
DROPPED_SQL = "CASE line WHEN 3 THEN 'это название завода, а не обозначение' WHEN 4 THEN 'это размер изделия, а не обозначение' WHEN 5 THEN 'это страна происхождения' WHEN 6 THEN 'это описание изделия или канцелярия, а не марка' WHEN 7 THEN 'это название завода, а не обозначение' END"


def _marked(spark, sf_dir):
    good, line = _text("KLT-", 100 + F.col("ru_number") % 7), F.col("line")
    said = (
        F.when(line == 1, F.concat(F.lit("1. "), good)).when(line == 2, F.concat(F.lit("Облучатель "), good)).when(line == 3, "ООО Луч")
        .when(line == 4, "302 мм").when(line == 5, "Россия").when(line == 6, "стол белый").otherwise(F.col("manufacturer"))
    )
    rows = positions(spark, sf_dir).select("contract", "line", "inn", "total", "manufacturer", said.alias("original"))
    return marks.tidied(rows.withColumn("mark", F.col("original")), "mark", "manufacturer")


@query("op.tidy_marks", f"{MARK_SQL} SELECT contract, line, inn, total, CASE WHEN line < 3 THEN good END AS mark, {DROPPED_SQL} AS dropped FROM m")
def tidy_marks(spark, sf_dir):
    return _marked(spark, sf_dir).select("contract", "line", "inn", "total", "mark", "dropped")


@query("op.mark_reasons", f"{MARK_SQL}, d AS (SELECT {DROPPED_SQL} AS dropped FROM m) SELECT dropped, count(*) AS n FROM d WHERE dropped IS NOT NULL GROUP BY 1")
def mark_reasons(spark, sf_dir):
    return marks.reasons(_marked(spark, sf_dir))


@query("op.mark_samples", f"""
{MARK_SQL}, d AS (SELECT {DROPPED_SQL} AS dropped, original, contract, line, inn, total FROM m)
SELECT dropped, original, contract, line, inn, total FROM d WHERE dropped IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dropped ORDER BY contract, line, inn, total, original) <= 40
""")
def mark_samples(spark, sf_dir):
    """The first 40 of each reason, as the report shows them."""
    return marks.samples(_marked(spark, sf_dir), "original", ["contract", "line", "inn", "total"])


@query("op.spelled_alike", """
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS mark FROM part),
k AS (SELECT *, regexp_replace(lower(mark), '[^a-z0-9]', '', 'g') AS key FROM r), c AS (SELECT key, mark, count(*) AS n, min(p_partkey) AS f FROM k GROUP BY ALL),
b AS (SELECT key, mark AS best FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, f) = 1)
SELECT p_partkey, best AS mark FROM k JOIN b USING (key)
""")
def spelled_alike(spark, sf_dir):
    mark = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return marks.spelled_alike(table(spark, sf_dir, "part").select("p_partkey", mark.alias("mark")), "mark", "p_partkey")


@query("op.refine_marks", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'KLT-' || p_partkey WHEN 1 THEN NULL ELSE 'Convelar ' || p_partkey END AS mark FROM part
""")
def refine_marks(spark, sf_dir):
    kind, number = F.col("p_size") % 3, F.col("p_partkey")
    mark = F.when(kind == 0, _text("KLT-", number, " Диксион")).when(kind == 1, F.lit("Диксион")).otherwise(_text("Convelar ", number))
    rows = table(spark, sf_dir, "part").select("p_partkey", mark.alias("mark"))
    return marks.refined(rows, "mark", F.array(F.lit("ООО «Диксион»"), F.lit(None).cast("string")))


@query("op.mark_from_registry", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'KLT-' || p_partkey END AS mark, p_size % 4 = 1 AS filled FROM part
""")
def mark_from_registry(spark, sf_dir):
    kind, number = F.col("p_size") % 4, F.col("p_partkey")
    record = F.when(kind == 2, _text("Установка стоматологическая KLT-", number, ", KLT-0")).otherwise(_text("Установка стоматологическая KLT-", number, " по ТУ 9452-001-90933304-2020"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(kind == 0, "own").alias("mark"), record.alias("record"), (kind != 3).alias("usable"))
    return marks.from_registry(rows, "mark", "record", F.array(F.lit("Установка стоматологическая")), F.col("usable")).select("p_partkey", "mark", "filled")


@query("op.confirm_kind", f"""
WITH {POSITION_SQL}, s AS (SELECT ktru, nkmi % 5 AS kind, CASE WHEN line = 1 THEN nkmi % 5 WHEN line = 2 THEN nkmi END AS said, contract FROM positions),
g AS (SELECT kind, ktru, count(*) FILTER (said = kind) AS same, min(said) FILTER (said <> kind) AS other, count(DISTINCT contract) FILTER (said IS NOT NULL) AS contracts FROM s GROUP BY ALL)
SELECT kind, ktru, contracts, CASE WHEN same > 0 THEN true WHEN other IS NOT NULL THEN false END AS confirmed, CASE WHEN same > 0 THEN kind ELSE other END AS found,
       CASE WHEN same > 0 THEN 'вид подтверждён контрактом' WHEN other IS NOT NULL THEN 'в контрактах по этому коду стоит вид ' || other ELSE 'в контрактах код вида не указан — проверить не по чему' END AS note FROM g
""")
def confirm_kind(spark, sf_dir):
    kind = F.col("nkmi") % 5
    said = F.when(F.col("line") == 1, kind).when(F.col("line") == 2, F.col("nkmi"))
    return marks.confirmed_kinds(positions(spark, sf_dir).select("ktru", kind.alias("kind"), said.alias("said"), "contract"), "kind", "ktru", "contract")


@query("op.is_type_word", "SELECT p_partkey, p_size % 4 IN (0, 1, 2) OR list_contains(string_split(p_name, ' '), lower(p_type)) AS typed FROM part")
def is_type_word(spark, sf_dir):
    kind = F.col("p_size") % 4
    word = F.when(kind == 0, "Светильники").when(kind == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 2, "РЗН").otherwise(F.upper("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", M.is_type_word(word, F.array("p_name")).alias("typed"))


@query("op.mark_keys", """
SELECT p_partkey, 'mercuryda' || p_partkey AS whole, 'mercury' AS first, CASE WHEN p_partkey > 9 THEN 'da' || p_partkey END AS later FROM part
""")
def mark_keys(spark, sf_dir):
    keys = M.mark_keys(_text("Mercury DA-", F.col("p_partkey")), F.array("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", keys.alias("k"))
    return rows.select("p_partkey", *[F.get("k", F.lit(i)).alias(n) for i, n in enumerate(("whole", "first", "later"))])


@query("op.same_family", "SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def same_family(spark, sf_dir):
    other = F.when(F.col("p_size") % 2 == 0, _text("BIRUSA", F.col("p_size"), " R")).otherwise(_text("Convelar-", F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", M.same_family(_text("Birusa-", F.col("p_partkey")), other).alias("same"))


@query("op.extends", "SELECT p_partkey, p_size % 3 = 0 AS extends, p_size % 3 <> 2 AS listed FROM part")
def extends(spark, sf_dir):
    kind, size = F.col("p_size") % 3, F.col("p_size")
    long = F.when(kind == 0, _text("AJ-", size)).otherwise(_text("AJax ", size))
    listed = F.when(kind == 2, F.lit("прочее")).otherwise(_text("модели AJ ", size, "; AJax ", size))
    return table(spark, sf_dir, "part").select("p_partkey", M.extends(F.lit("AJ"), long).alias("extends"), M.addition_listed(F.lit("AJ"), long, listed).alias("listed"))


@query("op.brand_tokens", "SELECT p_partkey, upper(p_type) AS first, 'DIXION' AS second FROM part")
def brand_tokens(spark, sf_dir):
    tokens = M.brand_tokens(F.array(_text("Светильник ", F.upper("p_type"), " ооо 5"), F.lit("DIXION LUCH")), F.array(F.lit("Светильник")))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.alias("t")).select("p_partkey", F.get("t", F.lit(0)).alias("first"), F.get("t", F.lit(1)).alias("second"))


@query("op.value_text", r"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'от ' || v || ' мм' WHEN 'view' THEN v || '–9 мм' WHEN 'error' THEN 'есть' ELSE v || ' мм' END AS "text"
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS v FROM events)
""")
def value_text(spark, sf_dir):
    kind, v, none = F.col("event_type"), F.get_json_object("props", "$.k"), F.lit(None).cast("string")
    text = M.value_text(F.when(kind == "error", "есть"), F.when(~kind.isin("click", "view"), v), F.when(kind.isin("click", "view"), v), F.when(kind == "view", "9").otherwise(none), F.lit("ММ"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("op.duration", """
WITH m AS (SELECT event_id, value * 100 AS s, CAST(round_even(value * 100 / 60, 0) AS INT) AS m FROM events)
SELECT event_id, CASE WHEN s < 45 THEN 'меньше минуты' WHEN m <= 1 THEN 'около минуты'
  WHEN m < 60 THEN 'около ' || m || CASE WHEN m % 10 = 1 AND m % 100 <> 11 THEN ' минуты' ELSE ' минут' END
  ELSE CASE WHEN m // 60 = 1 THEN 'около часа' WHEN (m // 60) % 10 = 1 AND (m // 60) % 100 <> 11 THEN 'около ' || (m // 60) || ' часа' ELSE 'около ' || (m // 60) || ' часов' END
       || CASE WHEN m % 60 < 10 THEN '' ELSE ' ' || (m % 60) || ' мин' END END AS said FROM m
""")
def duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.duration(F.col("value") * 100).alias("said"))


@query("op.form_header", """
SELECT o_orderkey, 'К-' || o_orderkey AS contract_number, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS purchase_number, round(o_totalprice, 2) AS contract_price, 'Заказчик ' || o_custkey AS customer, 'Поставщик' AS supplier,
       lpad(CAST(o_custkey AS VARCHAR), 10, '1') AS customer_inn, '7700000000' AS supplier_inn, CAST(o_orderdate AS DATE) AS signed FROM orders
""")
def form_header(spark, sf_dir):
    pair = lambda k, *v: F.concat(F.lit(f"<tr><td>{k}</td><td>"), _text(*v), F.lit("</td></tr>"))
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    html = F.concat(
        F.lit("<html><body><table>"), pair("Номер контракта", "К-", key), pair("Номер извещения об осуществлении закупки", "№ ", F.lpad(key.cast("string"), 19, "0")),
        pair("Цена контракта, руб.", F.format_string("%.2f", "o_totalprice")), pair("Сокращенное наименование заказчика", "Заказчик ", F.col("o_custkey")),
        pair("ИНН", F.lpad(F.col("o_custkey").cast("string"), 10, "1")), pair("Сокращенное наименование", "Поставщик"), pair("ИНН", "7700000000"),
        F.lit("</table><p>Дата и время подписания: 01.01.1990 10:00</p><p>Подпись заказчика <b>Дата и время подписания:</b> "), day, F.lit(" 12:00</p></body></html>"),
    )
    return P.form_headers(table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html")), "html").select(
        "o_orderkey", "contract_number", "purchase_number", "contract_price", "customer", "supplier", "customer_inn", "supplier_inn", "signed"
    )


@query("op.search_page", """
SELECT o_custkey, count(*) AS found, min(lpad(CAST(o_orderkey AS VARCHAR), 19, '0')) AS least, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS money FROM orders GROUP BY 1
""")
def search_page(spark, sf_dir):
    """A page for each customer, with an entry for each of their orders, read again."""
    entry = F.concat(F.lit('<div class="search-registry-entry-block">№ '), F.lpad(F.col("o_orderkey").cast("string"), 19, "0"), F.lit(" Цена: <span>"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")), F.lit(" ₽</span> 01.02.2024</div>"))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("<p>Найдено записей: "), F.count("*").cast("string"), F.lit("</p>"), F.array_join(F.collect_list(entry), "")).alias("html"))
    hits = pages.select("o_custkey", P.total_found(F.col("html")).alias("found"), F.explode(P.search_hits(F.col("html"))).alias("h"))
    return hits.groupBy("o_custkey", "found").agg(F.min("h.reestr_number").alias("least"), rollups.cents("h.price").alias("money"))


@query("op.save_report", f"""
WITH {CONTRACT_SQL}
SELECT stage, count(*) AS contracts, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS money FROM graded GROUP BY 1
""")
def save_report(spark, sf_dir):
    """The contracts' report, written and read again."""
    saved = R.save(contracts(spark, sf_dir).select("contract", "stage", "price", "bidding"), R.scratch(spark, "report"), ["stage"])
    return R.load(spark, saved).groupBy("stage").agg(F.count("*").alias("contracts"), rollups.cents("price").alias("money"))


@query("op.earlier", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01' AS before FROM orders")
def days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.earlier(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("01.06.1996")).alias("before"))


@query("op.name_variants", """
SELECT p_partkey, p_name || ', ' || p_type || ' / ' || p_brand AS whole, p_name || ', ' || p_type AS shorter, p_name AS shortest FROM part
""")
def name_variants(spark, sf_dir):
    asked = M.name_variants(F.concat("p_name", F.lit(", "), "p_type", F.lit(" / "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", asked.alias("v")).select("p_partkey", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("whole", "shorter", "shortest"))])
