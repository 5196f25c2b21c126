"""Queries over texts: codes, phrases, keys, marks, evidence, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import identifiers as I
from ..functions import names
from ..functions import normalise as N
from ..operators import canon, resolve, select
from ..sources import contract_xml
from ..sources import pages as P
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("op.drop_services", """
SELECT p_partkey, p_name FROM part WHERE p_size % 5 IN (0, 4)
""")
def drop_services(spark, sf_dir):
    kind = F.col("p_size") % 5
    said = F.when(kind == 1, "Ремонт и обслуживание: ").when(kind == 2, "Оказание услуг ").when(kind == 3, "Капитальный ремонт ").when(kind == 4, "Набор для ремонта ").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(said, "p_name").alias("title"))
    return select.without_services(rows, "title")[0].select("p_partkey", "p_name")


CODE_TEXT = "'коды 32.50.' || CAST(10 + p_size % 90 AS VARCHAR) || '.110-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 8, '0') || '; 26.60.12.119-00000205, 26.60.12.119-00000205 и 1.2.3'"


@query("op.parse_codes", rf"""
WITH c AS (SELECT p_partkey, list_distinct(regexp_extract_all({CODE_TEXT}, '\d{{2}}\.\d{{2}}\.\d{{2}}\.\d{{3}}-\d{{4,8}}')) AS codes FROM part)
SELECT p_partkey, len(codes) AS n, array_to_string(list_sort(codes), ' ') AS codes, CAST(1 AS BIGINT) AS near FROM c
""")
def parse_codes(spark, sf_dir):
    number = F.lpad((F.col("p_partkey") % 10000).cast("string"), 8, "0")
    text = F.concat(F.lit("коды 32.50."), (10 + F.col("p_size") % 90).cast("string"), F.lit(".110-"), number, F.lit("; 26.60.12.119-00000205, 26.60.12.119-00000205 и 1.2.3"))
    found = table(spark, sf_dir, "part").select("p_partkey", I.catalogue_codes(text).alias("c"), I.near_codes(text).alias("near"))
    return found.select("p_partkey", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort("c"), " ").alias("codes"), F.size("near").cast("long").alias("near"))


@query("op.name_key", """
WITH k AS (SELECT trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-zа-я0-9]+', ' ', 'g')) AS key FROM customer) SELECT key, count(*) AS n FROM k GROUP BY 1
""")
def name_key(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(N.name_key(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query("op.mark_key", """
WITH k AS (SELECT p_brand, regexp_replace(lower(translate(p_brand, 'АВЕКМНОРСТУХавекмнорстух', 'ABEKMHOPCTYXabekmhopctyx')), '[^a-zа-я0-9]+', '', 'g') AS key FROM part) SELECT key, p_brand, count(*) AS n FROM k GROUP BY ALL
""")
def mark_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", N.mark_key(F.col("p_brand")).alias("key")).groupBy("key", "p_brand").agg(F.count("*").alias("n"))


@query("op.company_key", r"""
WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ООО ' || s_name WHEN 1 THEN s_name || ' Ltd' WHEN 2 THEN 'ЗАО ' || s_name ELSE s_name END AS name FROM supplier),
w AS (SELECT s_suppkey, name, string_split(trim(regexp_replace(lower(name), '[^a-zа-я0-9]+', ' ', 'g')), ' ') AS ws FROM c)
SELECT s_suppkey, name, array_to_string(list_filter(ws, lambda x: x NOT IN ('ооо', 'зао', 'ltd')), '') AS core,
       CASE WHEN list_contains(ws, 'ооо') THEN 'ооо' WHEN list_contains(ws, 'зао') THEN 'ао' ELSE '' END AS form FROM w
""")
def company_key(spark, sf_dir):
    kind = F.col("s_suppkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("ООО "), "s_name")).when(kind == 1, F.concat("s_name", F.lit(" Ltd"))).when(kind == 2, F.concat(F.lit("ЗАО "), "s_name")).otherwise(F.col("s_name"))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return named.select("s_suppkey", "name", N.company_core(F.col("name")).alias("core"), N.legal_form(F.col("name")).alias("form"))


def _collapsed(sql: str) -> str:
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        sql = f"regexp_replace({sql}, '{letter}{letter}+', '{letter}', 'g')"
    return sql


def _phonetic_sql(column: str) -> str:
    sql = f"regexp_replace(lower({column}), '[^a-z0-9]+', '', 'g')"
    for a, b in N.PHONETIC_PAIRS:
        sql = f"replace({sql}, '{a}', '{b}')"
    return _collapsed(sql)


@query("op.phonetic", f"SELECT {_phonetic_sql('p_name')} AS key, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def phonetic(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(N.phonetic(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"))


@query("op.parse_phrase", r"""
WITH j AS (SELECT p_partkey, regexp_replace(p_brand, '\b([A-Za-z]{1,5})[ -]([0-9])', '\1\2', 'g') AS t FROM part),
w AS (SELECT p_partkey, list_transform(regexp_extract_all(t, '[0-9A-Za-z]+'), lambda x: lower(x)) AS ws FROM j)
SELECT p_partkey, array_to_string(list_filter(ws, lambda x: regexp_matches(x, '[0-9]')), ' ') AS articles,
       len(list_filter(ws, lambda x: NOT regexp_matches(x, '[0-9]') AND length(x) >= 3)) AS names FROM w
""")
def parse_phrase(spark, sf_dir):
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(I.phrase_articles(brand), " ").alias("articles"), F.size(I.phrase_names(brand)).cast("long").alias("names"))


@query("op.article_keys", r"""
WITH d AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё]+'),
             regexp_extract_all(text, '(?:^|[^0-9A-Za-zА-Яа-яЁё])([A-Za-zА-Яа-яЁё]{1,5}[ \-‑–]?\d[0-9A-Za-zА-Яа-яЁё]*)', 1)) AS ws FROM documents)
SELECT doc_id, len(list_distinct(list_filter(list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: regexp_matches(x, '[0-9]')))) AS n FROM d
""")
def article_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(I.article_keys(F.col("text"))).cast("long").alias("n"))


@query("op.judge", """
WITH p AS (SELECT p_partkey, lower(replace(p_brand, 'Brand#', 'brand')) AS art, p_name FROM part)
SELECT p_partkey,
       CASE WHEN contains(art, 'brand1') THEN true ELSE false END AS ok,
       CASE WHEN NOT contains(art, 'brand1') THEN '' WHEN contains(p_name, 'widget') THEN '' ELSE 'бренд' END AS doubt,
       CASE WHEN NOT contains(art, 'brand1') THEN 3 WHEN contains(p_name, 'widget') THEN 0 ELSE 1 END AS rank FROM p
""")
def judge(spark, sf_dir):
    chosen = F.concat_ws(" ", F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), "p_name")
    verdict = select.judge(F.lit("widget brand1"), chosen, F.lit(""), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", verdict.alias("v")).select("p_partkey", "v.ok", "v.doubt", "v.rank")


def _dealt_items(spark, sf_dir):
    """Every document beside an item of the benchmark, in turn."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    many = items.agg(F.count("*").alias("many"))  # one row
    return docs.crossJoin(F.broadcast(many)).join(items, F.col("doc_id") % F.col("many") == F.col("item_id"))


KEY_TOKENS = r"list_distinct(list_filter(regexp_extract_all(replace(lower({}), 'ё', 'е'), '[a-zа-я0-9\-]{{3,}}'), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in I.KEY_STOP) + "], x)))"


@query("op.jaccard_similarity", f"""
WITH b AS (SELECT item_id, {KEY_TOKENS.format("text")} AS bt, (SELECT count(*) FROM benchmark) AS many FROM benchmark),
d AS (SELECT doc_id, {KEY_TOKENS.format("text")} AS dt FROM documents)
SELECT doc_id, item_id, CASE WHEN len(dt) > 0 AND len(bt) > 0 THEN round(len(list_intersect(dt, bt)) / len(list_distinct(list_concat(dt, bt))), 6) ELSE 0.0 END AS similarity
FROM d JOIN b ON doc_id % many = item_id
""")
def jaccard_similarity(spark, sf_dir):
    """An item's tokens are taken once, before it meets its documents, and a document's once, before they are compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", I.key_tokens(F.col("text")).alias("said"))
    items = table(spark, sf_dir, "benchmark").select("item_id", I.key_tokens(F.col("text")).alias("asked"))
    many = items.agg(F.count("*").alias("many"))  # one row
    dealt = docs.crossJoin(F.broadcast(many)).join(items, F.col("doc_id") % F.col("many") == F.col("item_id"))
    both = N.let(F.struct("said", "asked"), lambda t: I.jaccard(t["said"], t["asked"]))
    return dealt.select("doc_id", "item_id", F.round(both, 6).alias("similarity"))


@query("op.doc_freq", """
WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')), ' '))) AS token FROM documents)
SELECT token, count(*) AS df, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM t WHERE length(token) >= 3 GROUP BY 1
""")
def doc_freq(spark, sf_dir):
    tokens = F.filter(F.split(N.name_key(F.col("text")), " "), lambda w: F.length(w) >= 3)
    return resolve.document_frequency(table(spark, sf_dir, "documents"), "doc_id", tokens)


@query("op.canon_case", """
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS word FROM documents),
c AS (SELECT lower(word) AS key, word, count(*) AS n, length(regexp_replace(word, '[^A-ZА-ЯЁ]', '', 'g')) AS caps FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, caps, word) AS place, count(*) OVER (PARTITION BY key) AS spellings FROM c)
SELECT key, word AS spelling, n, spellings FROM r WHERE place = 1
""")
def canon_case(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(I.every(F.col("text"), "[A-Za-z]{3,}")).alias("word"))
    return canon.canonical_case(tokens, "word")


@query("op.quote_supported", """
WITH w AS (SELECT item_id, (SELECT count(*) FROM benchmark) AS many,
                  list_filter(string_split(trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4) AS ws FROM benchmark)
SELECT doc_id, item_id, len(list_filter(ws, lambda x: contains(trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')), x))) * 2 >= len(ws) AS supported
FROM documents JOIN w ON doc_id % many = item_id
""")
def quote_supported(spark, sf_dir):
    return _dealt_items(spark, sf_dir).select("doc_id", "item_id", I.quote_supported(F.col("quote"), F.col("text")).alias("supported"))


@query("op.looks_like_mark", r"""
WITH c AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), upper(p_name)]) AS s FROM part)
SELECT s, count(*) AS n, (length(s) <= 60 AND NOT regexp_matches(s, '^[\d\s.,/-]+$') AND regexp_matches(s, '[A-Za-z0-9]')) AS mark FROM c GROUP BY 1
""")
def looks_like_mark(spark, sf_dir):
    values = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.upper("p_name"))
    rows = table(spark, sf_dir, "part").select(F.explode(values).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return rows.withColumn("mark", I.looks_like_mark(F.col("s")))


@query("op.strong_tokens", r"""
WITH d AS (SELECT p_partkey, p_brand || ' model ' || p_type AS s FROM part),
t AS (SELECT p_partkey, list_concat(regexp_extract_all(s, '[A-Za-z]{3,}'), regexp_extract_all(s, '[0-9]+')) AS ts FROM d)
SELECT p_partkey, array_to_string(list_filter(ts, lambda x: length(x) >= 2), ' ') AS tokens FROM t
""")
def strong_tokens(spark, sf_dir):
    text = F.concat("p_brand", F.lit(" model "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(I.strong_tokens(text), " ").alias("tokens"))


@query("op.extract_ru", r"""
WITH s AS (SELECT p_partkey, 'РУ № РЗН 20' || CAST(10 + p_size % 15 AS VARCHAR) || '/' || CAST(100 + p_partkey AS VARCHAR) || ' от 1.1.2020, фсз  2009/123' AS t FROM part)
SELECT p_partkey, 'РЗН ' || regexp_extract(t, 'РЗН (\d{4}/\d+)', 1) AS first_number, CAST(2 AS BIGINT) AS n FROM s
""")
def extract_ru(spark, sf_dir):
    text = F.concat(F.lit("РУ № РЗН 20"), (10 + F.col("p_size") % 15).cast("string"), F.lit("/"), (100 + F.col("p_partkey")).cast("string"), F.lit(" от 1.1.2020, фсз  2009/123"))
    numbers = table(spark, sf_dir, "part").select("p_partkey", I.registrations(text).alias("r"))
    return numbers.select("p_partkey", F.element_at("r", 1).alias("first_number"), F.size("r").cast("long").alias("n"))


@query("op.flatten_specs", """
SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || '; Тип: ' || event_type AS specs FROM events
""")
def flatten_specs(spark, sf_dir):
    pairs = F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda p: F.struct(F.concat(p["key"], F.lit(" :")).alias("name"), p["value"].alias("value")))
    more = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in (("Тип: ", F.col("event_type")), ("тип", F.lit("второй")), ("Пусто", F.lit("  ")))])
    return table(spark, sf_dir, "events").select("event_id", contract_xml.specs_text(F.concat(pairs, more)).alias("specs"))


@query("op.page_parts", r"""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading,
       len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links FROM pages
""")
def page_parts(spark, sf_dir):
    return P.page_parts(table(spark, sf_dir, "pages")).select("page_id", "title", "heading", F.size("links").cast("long").alias("links"))


@query("op.parse_print_form", """
SELECT l_orderkey, 'part ' || l_partkey AS name, l_quantity AS quantity, 'шт' AS unit, l_extendedprice AS price, round(l_quantity * l_extendedprice, 2) AS total FROM lineitem
""")
def parse_print_form(spark, sf_dir):
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    number = lambda c: F.format_string("%.2f", F.col(c))
    row = F.concat(F.lit("<tr><td>1</td>"), cell(F.lit("part "), F.col("l_partkey").cast("string")), cell(number("l_quantity")), cell(F.lit("шт")), cell(number("l_extendedprice")), F.lit("</tr>"))
    head = "<table><tr><th>Свод</th></tr></table><table><tr><th>№</th><th>Наименование товара</th><th>Количество</th><th>Единица измерения</th><th>Цена за единицу</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr>"
    # a contract's lines are few, as a document holds them
    forms = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    rows = forms.select("l_orderkey", F.explode(P.print_form(F.col("html"))).alias("p"))
    return rows.select("l_orderkey", "p.name", "p.quantity", "p.unit", "p.price", "p.total")


ATTACHMENTS = (
    "Контракт № {}.xml (12,5 КБ)", "Электронный контракт {}.xml", "Контракт {} с учётом доп. соглашений 1, 2.xml", "Счёт {}.xml", "Контракт {}.docx", "Доп. соглашение {}.xml", "Акт о приёмке {}.xml",
)


@query("op.pick_attachment", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Контракт ' || p_partkey || ' с учётом доп. соглашений 1, 2.xml' WHEN p_size % 4 = 1 THEN 'Электронный контракт ' || p_partkey || '.xml'
                       ELSE 'Контракт № ' || p_partkey || '.xml (12,5 КБ)' END AS file, CASE p_size % 4 WHEN 0 THEN 1002 WHEN 1 THEN 500 ELSE 100 END AS rank
FROM part WHERE p_size % 4 <> 3
""")
def pick_attachment(spark, sf_dir):
    named = lambda n: F.replace(F.lit(ATTACHMENTS[n]), F.lit("{}"), F.col("p_partkey").cast("string"))
    always = [named(n) for n in (3, 4, 5, 6)]
    kind = F.col("p_size") % 4
    files = F.when(kind == 0, F.array(*always, *[named(n) for n in (0, 1, 2)])).when(kind == 1, F.array(*always, named(0), named(1))).when(kind == 2, F.array(*always, named(0))).otherwise(F.array(*always))
    return select.pick_attachment(table(spark, sf_dir, "part").select("p_partkey", F.explode(files).alias("file")), "p_partkey", "file")


@query("op.starting_price", r"""
WITH n AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: CAST(x AS DOUBLE))) AS ps FROM pages),
k AS (SELECT page_id, list_filter(ps, lambda p: p > 0) AS ks FROM n)
SELECT page_id, CASE WHEN len(ks) = 1 THEN ks[1] END AS value, CASE WHEN len(ks) > 1 THEN 'совместная закупка: начальных цен несколько' ELSE '' END AS note FROM k
""")
def starting_price(spark, sf_dir):
    prices = F.transform(I.every(F.col("url"), "[0-9]+"), lambda x: x.cast("double"))
    return table(spark, sf_dir, "pages").select("page_id", I.starting_price(prices).alias("p")).select("page_id", "p.value", "p.note")


@query("op.parse_contract_xml", """
WITH p AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity,
                  '<productInfo><name>part ' || l_partkey || '</name><price>' || l_extendedprice || '</price><quantity>' || l_quantity || '</quantity></productInfo>' AS x
           FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS reestr_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) - 1 AS line, 'part ' || l_partkey AS name,
       l_extendedprice AS price, l_quantity AS quantity, round(l_extendedprice * l_quantity, 2) AS total FROM p
""")
def parse_contract_xml(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    product = F.concat(F.lit("<productInfo><name>part "), F.col("l_partkey").cast("string"), F.lit("</name><price>"), F.col("l_extendedprice").cast("string"), F.lit("</price><quantity>"), F.col("l_quantity").cast("string"), F.lit("</quantity></productInfo>"))
    body = F.array_join(F.array_sort(F.collect_list(product)), "")
    made = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<export><contract><regNum>"), F.first(F.col("l_orderkey").cast("string")), F.lit("</regNum>"), body, F.lit("</contract></export>")).alias("xml"))
    return contract_xml.positions(made, "xml").select("reestr_number", "line", "name", "price", "quantity", "total")


@query("op.parse_name", """
WITH n AS (SELECT p_partkey, upper(p_type) || '-' || p_size AS model,
                  array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) < 4), lambda x: upper(x[1]) || x[2:]), ' ') AS brand FROM part)
SELECT p_partkey, brand, model, '' AS variant, trim(brand || ' ' || model) AS "full" FROM n
""")
def parse_name(spark, sf_dir):
    title = F.concat(F.initcap("p_name"), F.lit(", модель "), F.upper("p_type"), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", names.parse_name(title, F.array("p_name")).alias("n")).select("p_partkey", "n.*")


@query("op.similarity")
def similarity(spark, sf_dir):
    """Each item of the benchmark beside the next; held against a plain version by the tests, as SQL has no likeness of letters in order."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return items.join(following, "item_id").select("item_id", F.round(names.similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


@query("op.phonetic_close")
def phonetic_close(spark, sf_dir):
    """Brands beside part names, each distinct pair once; held against a plain version by the tests."""
    pairs = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("a"), F.reverse("p_type").alias("b")).distinct()
    return pairs.select("a", "b", names.phonetic_close(F.col("a"), F.concat("b", F.lit(" "), F.substring_index("a", " ", 2))).alias("close"))


_SAME_WORD = "(w = x OR (least(length(w), length(x)) >= 5 AND left(w, greatest(5, least(length(w), length(x)) - 3)) = left(x, greatest(5, least(length(w), length(x)) - 3))))"


def _words_like(words: str, others: str) -> str:
    return f"len(list_filter({words}, lambda w: len(list_filter({others}, lambda x: {_SAME_WORD})) > 0))"


@query("op.name_match", f"""
WITH n AS (SELECT DISTINCT p_name AS kind, p_name || 's для ' || lower(p_type) AS card FROM part),
w AS (SELECT kind, card, string_split(kind, ' ') AS k, list_filter(string_split(card, ' '), lambda y: length(y) > 2 AND y <> 'для') AS c FROM n)
SELECT kind, card, CASE WHEN {_words_like("[k[1]]", "c")} = 0 THEN 0.0 ELSE round(greatest({_words_like("k", "c")} / len(k), {_words_like("c", "k")} / len(c)), 6) END AS score FROM w
""")
def name_match(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("kind"), F.concat("p_name", F.lit("s для "), F.lower("p_type")).alias("card")).distinct()
    return pairs.select("kind", "card", F.round(E.name_match(F.col("kind"), F.col("card")), 6).alias("score"))


@query("op.registry_variants", """
SELECT p_brand, count(DISTINCT p_type || '-' || p_size) AS n, string_agg(DISTINCT p_type || '-' || p_size, ',' ORDER BY p_type || '-' || p_size) AS variants FROM part GROUP BY 1
""")
def registry_variants(spark, sf_dir):
    listed = F.array_join(F.array_sort(F.collect_set(F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")))), "; ")
    records = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("Варианты исполнения: "), listed).alias("t"))
    return records.select("p_brand", names.registry_variants(F.col("t")).alias("v")).select("p_brand", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("variants"))
