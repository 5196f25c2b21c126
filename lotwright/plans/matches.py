"""Queries that resolve positions through the registry and through each other, and canonicalise names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import canon, resolve, rollups, select
from ..sources.tables import table
from .bindings import POSITION_SQL, positions
from .reports import PRODUCER_SQL

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


ROW = ["contract", "line", "inn", "total"]

#: The registry: all parts, some under a number that no position has, so that looking them up fails.
REGISTRY_SQL = "(SELECT * REPLACE (CASE WHEN p_size < 25 THEN p_partkey ELSE -1 - p_partkey END AS p_partkey) FROM part) AS registry"


def _registry(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("p_partkey", F.when(F.col("p_size") < 25, F.col("p_partkey")).otherwise(-1 - F.col("p_partkey")))


@query("op.registry_lookup", f"WITH {POSITION_SQL} SELECT contract, line, inn, total, p.ru_number, p_brand AS producer FROM positions p LEFT JOIN {REGISTRY_SQL} ON p.ru_number = p_partkey")
def registry_lookup(spark, sf_dir):
    rows = positions(spark, sf_dir).select(*ROW, "ru_number")
    known = _registry(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("producer"))
    asked = rows.select("ru_number").distinct()
    answers = asked.join(known, F.col("ru_number") == F.col("k")).select(F.col("ru_number").alias("a"), "producer")
    return rows.join(answers, F.col("ru_number") == F.col("a"), "left").select(*ROW, "ru_number", "producer")


@query("op.registry_cascade", f"""
WITH {POSITION_SQL}, a AS (SELECT p_partkey AS k, min(p_brand) AS p, count(DISTINCT p_brand) AS c FROM {REGISTRY_SQL} GROUP BY 1),
b AS (SELECT p_name || p_type AS k, min(p_brand) AS p, count(DISTINCT p_brand) AS c FROM {REGISTRY_SQL} GROUP BY 1)
SELECT contract, line, inn, total, CASE WHEN a.c = 1 THEN a.p WHEN b.c = 1 THEN b.p END AS producer, CASE WHEN a.c = 1 THEN 'ru_number' WHEN b.c = 1 THEN 'title' END AS found_by
FROM positions LEFT JOIN a ON ru_number = a.k LEFT JOIN b ON name || ktru = b.k
""")
def registry_cascade(spark, sf_dir):
    asked = positions(spark, sf_dir).select(*ROW, "ru_number", F.concat("name", "ktru").alias("title"))
    registry = _registry(spark, sf_dir).select("p_partkey", "p_brand", F.concat("p_name", "p_type").alias("t"))
    found = resolve.registry_cascade(asked, registry, [("ru_number", "p_partkey"), ("title", "t")], "p_brand", N.producer_key(F.col("p_brand")))
    return found.select(*ROW, "producer", "found_by")


@query("op.apply_registry", f"""
WITH {POSITION_SQL}, p AS (SELECT *, CASE WHEN line > 2 THEN manufacturer END AS m, 'KLT-' || CAST(100 + line AS VARCHAR) AS mark0 FROM positions),
r AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_size % 2 = 0 THEN p_name || ' KLT-103' ELSE 'прочее' END AS r_name FROM {REGISTRY_SQL})
SELECT contract, line, inn, total, coalesce(m, p_brand) AS manufacturer,
       CASE WHEN m IS NOT NULL THEN 'contract' WHEN p_brand IS NOT NULL THEN 'registry' ELSE 'none' END AS source,
       CASE WHEN m IS NOT NULL THEN 'high' WHEN p_brand IS NULL THEN '' WHEN p_size % 2 = 0 AND regexp_matches(name, '[A-Za-z]{{4,}}') THEN 'high' ELSE 'medium' END AS confidence,
       p_type AS holder, CASE WHEN p_size < 12 THEN 'действует' WHEN p_size < 25 THEN 'отменён' END AS status,
       CASE WHEN p_brand IS NOT NULL THEN 'РЗН ' || ru_number ELSE CAST(ru_number AS VARCHAR) END AS unified,
       CASE WHEN p_size % 2 = 0 AND line <> 3 AND p_brand IS NOT NULL THEN NULL ELSE mark0 END AS mark
FROM p LEFT JOIN r ON ru_number = p_partkey
""")
def apply_registry(spark, sf_dir):
    registry = _registry(spark, sf_dir).select(
        "p_partkey", F.col("p_brand").alias("producer"), F.col("p_type").alias("declarant"), F.when(F.col("p_size") < 12, "действует").otherwise("отменён").alias("status"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" KLT-103"))).otherwise("прочее").alias("r_name"), F.concat(F.lit("РЗН "), F.col("p_partkey").cast("string")).alias("unified"),
    )
    rows = positions(spark, sf_dir).select(
        *ROW, "ru_number", "name", F.when(F.col("line") > 2, F.col("manufacturer")).alias("manufacturer"), F.concat(F.lit("KLT-"), (100 + F.col("line")).cast("string")).alias("mark")
    )
    return resolve.apply_registry(rows, "ru_number", registry, "p_partkey").drop("ru_number", "name")


def _transfer_sql(key: str) -> str:
    return f"""
WITH {POSITION_SQL}, b AS (SELECT *, CASE WHEN line <> 1 THEN manufacturer END AS m FROM positions),
d AS (SELECT {key} AS k, count(DISTINCT m) AS companies, min(m) AS donated FROM b WHERE m IS NOT NULL GROUP BY 1)
SELECT contract, line, inn, total, CASE WHEN m IS NULL AND companies = 1 THEN donated ELSE m END AS filled,
       CASE WHEN m IS NOT NULL THEN 'own' WHEN companies = 1 THEN 'donor' ELSE 'none' END AS source, m IS NULL AND coalesce(companies > 1, false) AS conflict
FROM b LEFT JOIN d ON {key} = k
"""


def _transfer(spark, sf_dir, key):
    rows = positions(spark, sf_dir).select(*ROW, key.alias("k"), F.when(F.col("line") != 1, F.col("manufacturer")).alias("m"))
    donors = resolve.unanimous(rows, ["k"], "m", N.producer_key(F.col("m")), "m")
    return resolve.fill(rows, donors, ["k"], "m").select(*ROW, "filled", "source", "conflict")


@query("op.transfer_by_number", _transfer_sql("ru_number || '/' || nkmi"))
def transfer_by_number(spark, sf_dir):
    return _transfer(spark, sf_dir, F.concat_ws("/", "ru_number", "nkmi"))


@query("op.transfer_by_mark", _transfer_sql("name || '/' || nkmi"))
def transfer_by_mark(spark, sf_dir):
    return _transfer(spark, sf_dir, F.concat_ws("/", "name", "nkmi"))


@query("op.extend_marks", """
WITH r AS (SELECT p_partkey, p_size AS number, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS mark FROM part),
m AS (SELECT DISTINCT number, mark FROM r),
e AS (SELECT a.number, a.mark, count(*) AS c, min(b.mark) AS long FROM m a JOIN m b ON a.number = b.number AND starts_with(b.mark, a.mark) AND b.mark <> a.mark AND NOT regexp_matches(substr(b.mark, length(a.mark) + 1, 1), '[A-Za-z]') GROUP BY ALL)
SELECT p_partkey, r.number, r.mark, CASE WHEN c = 1 THEN long ELSE r.mark END AS extended FROM r LEFT JOIN e ON r.number = e.number AND r.mark = e.mark
""")
def extend_marks(spark, sf_dir):
    short = F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("number"), short.alias("mark"))
    return resolve.extend_marks(rows, "number", "mark")


@query("op.kind_slice", """
SELECT p_partkey, p_name, p_brand, (SELECT count(*) FROM part WHERE p_size = 7) AS total, (SELECT count(*) FROM part WHERE p_size = 7) > 1200 AS truncated, false AS unfiltered
FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 1200
""")
def kind_slice(spark, sf_dir):
    registry = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return select.kind_slice(registry, F.col("p_size") == 7, ["p_partkey"]).drop("p_size")


@query("op.kind_match", f"""
WITH {POSITION_SQL}, q AS (SELECT DISTINCT nkmi, name, ktru FROM positions),
t AS (SELECT DISTINCT nkmi, name, ktru, unnest(list_concat(string_split(name, ' '), [ktru])) AS token FROM q),
k AS (SELECT p_size, p_name, p_type, p_brand, min(p_partkey) AS r FROM part GROUP BY ALL),
r AS (SELECT DISTINCT r, p_size, p_brand, unnest(list_concat(string_split(p_name, ' '), [p_type])) AS token FROM k),
z AS (SELECT p_size, count(*) AS records FROM k GROUP BY 1), f AS (SELECT p_size, token, count(*) / max(records) AS share FROM r JOIN z USING (p_size) GROUP BY ALL),
s AS (SELECT nkmi, name, ktru, r, p_brand, sum(CASE WHEN length(t.token) >= 5 THEN 3.0 ELSE 2.0 END) AS score
      FROM t JOIN f ON f.p_size = nkmi AND f.token = t.token AND share <= 0.3 JOIN r ON r.p_size = nkmi AND r.token = t.token GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY nkmi, name, ktru) AS top FROM s),
a AS (SELECT nkmi, name, ktru, CAST(max(top) AS DOUBLE) AS score, min(p_brand) AS producer FROM b WHERE score >= top - 0.01 AND top >= 3 GROUP BY ALL HAVING count(DISTINCT p_brand) = 1)
SELECT contract, line, inn, total, score, producer FROM positions JOIN a USING (nkmi, name, ktru)
""")
def kind_match(spark, sf_dir):
    """Positions of a kind, name and code ask one question; records of a kind, name, code and producer are one record."""
    tokens = lambda kind, name, code: F.transform(F.array_distinct(F.concat(F.split(name, " "), F.array(code))), lambda t: F.concat_ws("/", F.col(kind), t))
    rows = positions(spark, sf_dir).select(*ROW, "nkmi", "name", "ktru")
    questions = rows.select(F.struct("nkmi", "name", "ktru").alias("q")).distinct()
    asked = questions.select("q", F.explode(tokens("q.nkmi", "q.name", "q.ktru")).alias("token"))
    records = table(spark, sf_dir, "part").groupBy("p_size", "p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("r"))
    held = records.select("r", "p_size", F.col("p_brand").alias("firm"), F.explode(tokens("p_size", "p_name", "p_type")).alias("token"))
    sizes = records.groupBy("p_size").agg(F.count("*").alias("records"))
    frequency = held.groupBy("p_size", "token").agg(F.count("*").alias("df")).join(sizes, "p_size").select("token", (F.col("df") / F.col("records")).alias("share"))
    answers = resolve.match_rules(asked, held.drop("p_size"), frequency, plain=F.split_part("token", F.lit("/"), F.lit(2)))
    return rows.join(answers.select("q.*", "score", F.col("firm").alias("producer")), ["nkmi", "name", "ktru"]).select(*ROW, "score", "producer")


@query("op.match_rules", """
WITH d AS (SELECT doc_id, source, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')), ' '))) AS token FROM documents),
f AS (SELECT token, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM d GROUP BY 1),
q AS (SELECT item_id AS q, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-zа-я0-9]+', ' ', 'g')), ' '))) AS token FROM benchmark),
s AS (SELECT q, doc_id AS r, source AS firm, round(sum(CASE WHEN regexp_matches(q.token, '[0-9]') THEN CASE WHEN length(q.token) >= 4 THEN 4.0 ELSE 2.5 END WHEN length(q.token) >= 5 THEN 3.0 ELSE 2.0 END), 4) AS score
      FROM q JOIN f ON q.token = f.token AND share <= 0.02 JOIN d ON d.token = q.token WHERE length(q.token) >= 3 GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM s)
SELECT q, min(r) AS r, CAST(max(top) AS DOUBLE) AS score, min(firm) AS firm FROM b WHERE score >= top - 0.01 AND top >= 3 GROUP BY 1 HAVING count(DISTINCT firm) = 1
""")
def match_rules(spark, sf_dir):
    tokens = F.array_distinct(F.filter(F.split(N.name_key(F.col("text")), " "), lambda w: F.length(w) >= 3))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").alias("q"), F.explode(tokens).alias("token"))
    asked = questions.select("token").distinct()
    # tokens that no question has are dropped before anything is counted or shuffled by token
    frequency = resolve.document_frequency(docs, "doc_id", tokens, asked)
    records = docs.select(F.col("doc_id").alias("r"), F.col("source").alias("firm"), F.explode(tokens).alias("token")).join(asked, "token", "left_semi")
    return resolve.match_rules(questions, records, frequency, most_share=0.02)


@query("op.bridge_kind", f"""
WITH {POSITION_SQL}, s AS (SELECT nkmi, ktru, count(DISTINCT contract) AS contracts FROM positions GROUP BY ALL), k AS (SELECT ktru, count(DISTINCT nkmi) AS kinds FROM positions GROUP BY 1)
SELECT nkmi, s.ktru, contracts, kinds = 1 AS only_kind FROM s JOIN k USING (ktru)
""")
def bridge_kind(spark, sf_dir):
    return resolve.bridge(positions(spark, sf_dir), "nkmi", "ktru", "contract")


@query("op.firm_search", f"""
WITH {POSITION_SQL}, n AS (SELECT DISTINCT ru_number FROM positions WHERE manufacturer = 'Brand#3' AND nkmi = 5),
s AS (SELECT DISTINCT inn FROM positions WHERE ru_number IN (SELECT ru_number FROM n))
SELECT DISTINCT ru_number FROM positions WHERE inn IN (SELECT inn FROM s)
""")
def firm_search(spark, sf_dir):
    rows = positions(spark, sf_dir)
    seeds = rows.filter("manufacturer = 'Brand#3' AND nkmi = 5").select("ru_number").distinct()
    return resolve.two_hop(rows.select("ru_number", "inn"), seeds, "ru_number", "inn")


@query("op.assign_groups", """
WITH c AS (SELECT p_brand AS name, count(*) AS n, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand1' ELSE regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') END AS key FROM part GROUP BY 1),
t AS (SELECT key, name AS title FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, length(name), name DESC) = 1)
SELECT name, title FROM c JOIN t USING (key)
""")
def assign_groups(spark, sf_dir):
    key = F.when(F.col("name").isin("Brand#1", "Brand#2"), "brand1").otherwise(N.group_key(F.col("name")))
    return canon.assign_groups(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")), "name", key)


@query("op.merge_companies", """
WITH n AS (SELECT s_suppkey, 'Supplier ' || CAST(s_suppkey % 20 AS VARCHAR) AS core0, CASE s_suppkey % 3 WHEN 0 THEN 'ООО ' WHEN 1 THEN 'АО ' ELSE '' END AS f FROM supplier),
k AS (SELECT *, f || core0 AS name, lower(replace(core0, ' ', '')) AS core, lower(trim(f)) AS form FROM n),
z AS (SELECT core, form, count(*) AS c FROM k WHERE form <> '' GROUP BY ALL), l AS (SELECT core, form AS largest FROM z QUALIFY row_number() OVER (PARTITION BY core ORDER BY c DESC, form DESC) = 1),
j AS (SELECT k.core, CASE WHEN k.form = '' THEN coalesce(largest, '') ELSE k.form END AS form, name, s_suppkey FROM k LEFT JOIN l ON k.core = l.core),
m AS (SELECT core, form, name, count(*) AS n, min(s_suppkey) AS p FROM j GROUP BY ALL)
SELECT core, form, name AS title, n FROM m QUALIFY row_number() OVER (PARTITION BY core, form ORDER BY n DESC, p) = 1
""")
def merge_companies(spark, sf_dir):
    kind = F.col("s_suppkey") % 3
    name = F.concat(F.when(kind == 0, "ООО ").when(kind == 1, "АО ").otherwise(""), F.lit("Supplier "), (F.col("s_suppkey") % 20).cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return canon.merge_companies(rows, "name", N.company_core(F.col("name")), N.legal_form(F.col("name")), "s_suppkey")


def _grouped(spark, sf_dir, groups):
    titles = canon.group_table(spark, groups)
    rows = positions(spark, sf_dir).withColumn("key", N.group_key(F.col("manufacturer")))
    # the table of groups is what users typed in
    return rollups.producers(rows.join(titles, "key", "left").withColumn("title", F.coalesce("manual", "manufacturer")), "title")


GROUPS = {"First": ["Brand#1", "Brand#2"], "Third": ["Brand#3", "Brand#4", "Brand#5"]}


@query("op.group_merge", PRODUCER_SQL.format(title="CASE WHEN manufacturer IN ('Brand#1', 'Brand#2', 'Brand#7') THEN 'First' WHEN manufacturer IN ('Brand#3', 'Brand#4', 'Brand#5') THEN 'Third' ELSE manufacturer END"))
def group_merge(spark, sf_dir):
    return _grouped(spark, sf_dir, canon.merge_groups(GROUPS, ["brand 2", "Brand#7"], "First"))


@query("op.group_split", PRODUCER_SQL.format(title="CASE WHEN manufacturer IN ('Brand#3', 'Brand#5') THEN 'Third' ELSE manufacturer END"))
def group_split(spark, sf_dir):
    return _grouped(spark, sf_dir, canon.split_groups(GROUPS, ["Brand#4", "BRAND 1"]))


@query("op.registry_gaps", f"""
WITH {POSITION_SQL}
SELECT count(*) AS positions, count(*) FILTER (p_brand IS NULL) AS without_manufacturer, count(*) FILTER (p_brand IS NOT NULL AND (line = 3 OR line <> 4 AND NOT regexp_matches(name, '[A-Za-z]{{4,}}'))) AS mismatched
FROM positions LEFT JOIN {REGISTRY_SQL} ON ru_number = p_partkey
""")
def registry_gaps(spark, sf_dir):
    known = _registry(spark, sf_dir).select("p_partkey", "p_brand", F.concat(F.lit("Изделие "), "p_name").alias("r_name"))
    said = F.when(F.col("line") == 3, "Иное изделие").when(F.col("line") == 4, F.concat(F.lit("изделие: "), "name")).otherwise(F.concat(F.lit("Набор "), "name"))
    rows = positions(spark, sf_dir).withColumn("said", said).join(known, F.col("ru_number") == F.col("p_partkey"), "left")
    return rollups.registry_gaps(rows, "said", "p_brand", "r_name")


DOUBT_SQL = f"WITH {POSITION_SQL}, d AS (SELECT contract, line, inn, total, ru_number, manufacturer, CASE WHEN line = 1 THEN 'бренд' WHEN line = 2 THEN 'исполнение' ELSE '' END AS doubt FROM positions)"


def _doubtful(spark, sf_dir):
    doubt = F.when(F.col("line") == 1, "бренд").when(F.col("line") == 2, "исполнение").otherwise("")
    return positions(spark, sf_dir).select(*ROW, "ru_number", "manufacturer", doubt.alias("doubt"))


@query("op.confirm_brand", f"""
{DOUBT_SQL} SELECT contract, line, inn, total, CASE WHEN doubt = 'бренд' AND p_type = 'PROMO' THEN '' ELSE doubt END AS doubt, doubt = 'бренд' AND coalesce(p_type = 'PROMO', false) AS confirmed
FROM d LEFT JOIN {REGISTRY_SQL} ON ru_number = p_partkey
""")
def confirm_brand(spark, sf_dir):
    known = _registry(spark, sf_dir).select("p_partkey", F.concat("p_brand", F.lit(", "), F.lower("p_type")).alias("record"))
    rows = _doubtful(spark, sf_dir).join(known, F.col("ru_number") == F.col("p_partkey"), "left")
    return select.confirm_brand(rows, "doubt", F.lit("ПРОМО AJ-15"), F.col("record")).select(*ROW, "doubt", "confirmed")


@query("op.resolve_variant", f"""
{DOUBT_SQL}, a AS (SELECT p_partkey, p_size FROM {REGISTRY_SQL})
SELECT contract, line, inn, total, CASE WHEN doubt = 'исполнение' AND p_size = 9 THEN '' ELSE doubt END AS doubt FROM d LEFT JOIN a ON ru_number = p_partkey
WHERE NOT (doubt = 'исполнение' AND coalesce(p_size % 3 = 0 AND p_size <> 9, false))
""")
def resolve_variant(spark, sf_dir):
    """Every third answer is borne out by its quotation; others quote what doesn't name the variant, or invent a quotation."""
    size = F.col("p_size").cast("string")
    answers = _registry(spark, sf_dir).select(
        "p_partkey", F.concat(F.lit("DA "), size).alias("variant"), F.concat(F.lit("Стул врача, модель DA-"), size, F.lit(" белая, с подставкой")).alias("text"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("модель DA-"), size, F.lit(" белая"))).when(F.col("p_size") % 3 == 1, "модель белая").otherwise(F.concat(F.lit("кресло зелёное DA-"), size)).alias("quote"),
    )
    rows = _doubtful(spark, sf_dir).join(answers, F.col("ru_number") == F.col("p_partkey"), "left")
    return select.resolve_variant(rows, "doubt", F.lit("DA-9"), F.col("variant"), F.col("quote"), F.col("text")).select(*ROW, "doubt")
