"""Queries that report: roll-ups, price reductions, coverage, remarks, the report itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import prices
from ..operators import ranking, rollups
from ..sources.tables import table
from .bindings import CONTRACT_SQL, POSITION_SQL, contracts, positions

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


PRODUCER_SQL = f"""
WITH {POSITION_SQL}, grouped AS (
  SELECT {{title}} AS producer, count(*) AS positions, count(DISTINCT contract) AS contracts, CAST(sum(quantity) AS DOUBLE) AS units,
         CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS money, round(median(price), 4) AS median_price,
         min(price) AS least_price, max(price) AS most_price, count(DISTINCT declarant) AS declarants,
         CASE WHEN count(DISTINCT declarant) = 1 THEN max(declarant) END AS declarant
  FROM positions GROUP BY 1)
SELECT *, round(100 * money / sum(money) OVER (), 1) AS share FROM grouped
"""


@query("op.producers", PRODUCER_SQL.format(title="manufacturer"))
def producers(spark, sf_dir):
    return rollups.producers(positions(spark, sf_dir))


@query("op.sort_producers", f"""
WITH {POSITION_SQL}, g AS (SELECT CASE WHEN manufacturer <> 'Brand#1' THEN manufacturer END AS producer, count(*) AS n FROM positions GROUP BY 1)
SELECT row_number() OVER (ORDER BY producer IS NULL, n DESC, producer) AS place, producer, n FROM g
""")
def sort_producers(spark, sf_dir):
    known = F.when(F.col("manufacturer") != "Brand#1", F.col("manufacturer"))
    grouped = positions(spark, sf_dir).groupBy(known.alias("producer")).agg(F.count("*").alias("n"))
    order = ranking.Window.orderBy(F.col("producer").isNull(), F.col("n").desc(), "producer")
    return grouped.select(F.row_number().over(order).cast("long").alias("place"), "producer", "n")


@query("op.summary", f"""
WITH {POSITION_SQL}
SELECT count(*) AS positions, count(DISTINCT contract) AS contracts, count(manufacturer) AS with_manufacturer,
       CAST(round(100 * count(manufacturer) / count(*), 0) AS BIGINT) AS with_manufacturer_pct, count(ru_number) AS with_ru,
       CAST(round(100 * count(ru_number) / count(*), 0) AS BIGINT) AS with_ru_pct, count(DISTINCT manufacturer) AS producers,
       count(DISTINCT inn) AS suppliers, count(DISTINCT c_name) AS customers,
       CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS money,
       strftime(min(o_orderdate), '%d.%m.%Y') AS first_date, strftime(max(o_orderdate), '%d.%m.%Y') AS last_date
FROM positions JOIN orders ON contract = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def summary(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = positions(spark, sf_dir).join(orders, F.col("contract") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rollups.summary(rows.select("*", F.col("inn").alias("supplier"), F.col("c_name").alias("customer"), F.col("o_orderdate").alias("date")))


@query("op.no_bidding", f"WITH {CONTRACT_SQL} SELECT contract, bidding, why FROM graded")
def no_bidding(spark, sf_dir):
    return contracts(spark, sf_dir).select("contract", "bidding", "why")


@query("op.discount_pct", f"""
WITH {CONTRACT_SQL}
SELECT contract, raw_pct, CASE WHEN bidding = '—' THEN raw_pct END AS percent, CASE WHEN bidding = '—' THEN round(nmck - price, 2) END AS discount FROM graded
""")
def discount_pct(spark, sf_dir):
    return contracts(spark, sf_dir).select("contract", "raw_pct", "percent", prices.discount(F.col("bidding"), F.col("nmck"), F.col("price")).alias("discount"))


@query("op.discount_stats", f"""
WITH {CONTRACT_SQL}, p AS (SELECT *, CASE WHEN bidding = '—' THEN raw_pct END AS percent FROM graded)
SELECT stage, round(median(percent) FILTER (percent > 0), 4) AS median_pct, max(percent) AS most_pct, count(*) FILTER (percent > 0) AS lowered,
       count(percent) AS known, count(*) AS contracts,
       count(*) FILTER (bidding IN ('торгов не было', 'торгов не было: закупка малого объёма')) AS no_bidding, count(*) FILTER (why <> '') AS incomparable
FROM p GROUP BY 1
""")
def discount_stats(spark, sf_dir):
    return rollups.discount_stats(contracts(spark, sf_dir), ["stage"])


@query("op.discount_note", f"""
WITH {CONTRACT_SQL}, p AS (SELECT *, CASE WHEN bidding = '—' THEN raw_pct END AS percent FROM graded),
g AS (SELECT stage, count(*) FILTER (percent > 0) AS lowered, count(percent) AS known, max(percent) AS most,
             count(*) FILTER (bidding IN ('торгов не было', 'торгов не было: закупка малого объёма')) AS nb, count(*) FILTER (why <> '') AS inc FROM p GROUP BY 1),
w AS (SELECT *, CASE WHEN known % 10 = 1 AND known % 100 <> 11 THEN 'контракта' ELSE 'контрактов' END AS kw, CASE WHEN inc % 10 = 1 AND inc % 100 <> 11 THEN 'контракта' ELSE 'контрактов' END AS iw FROM g)
SELECT stage, CASE WHEN known = 0 AND nb > 0 THEN 'торгов не было' WHEN known = 0 THEN 'начальная цена неизвестна'
                   ELSE 'снижали в ' || lowered || ' из ' || known || ' ' || kw || ', максимум −' || CAST(round(most, 1) AS VARCHAR) || '%' END
              || CASE WHEN nb > 0 AND known > 0 THEN '; ещё ' || nb || ' без торгов' ELSE '' END
              || CASE WHEN inc > 0 THEN '; у ' || inc || ' ' || iw || ' цену сравнить не с чем' ELSE '' END AS note
FROM w
""")
def discount_note(spark, sf_dir):
    stats = rollups.discount_stats(contracts(spark, sf_dir), ["stage"])
    return stats.select("stage", prices.discount_note(*map(F.col, ("lowered", "known", "no_bidding", "incomparable", "most_pct"))).alias("note"))


@query("op.remarks", f"""
WITH {POSITION_SQL}, odd AS (
  SELECT *, CASE WHEN line <> 7 THEN manufacturer END AS m, CASE WHEN tax <> 0 THEN ru_number END AS r,
         CASE WHEN tax <> 0.08 THEN price END AS p, CASE WHEN quantity <> 50 THEN quantity END AS q, total * (1 + tax) AS t FROM positions)
SELECT count(*) FILTER (m IS NULL) AS no_manufacturer, count(*) FILTER (r IS NULL) AS no_ru, count(*) FILTER (p IS NULL) AS no_price,
       count(*) FILTER (q IS NULL) AS no_quantity, count(*) FILTER (abs(p * q - t) > greatest(1.0, 0.01 * abs(t))) AS off_sum FROM odd
""")
def remarks(spark, sf_dir):
    only = lambda c, keep: F.when(keep, F.col(c))
    return rollups.remarks(positions(spark, sf_dir).select(
        only("manufacturer", F.col("line") != 7).alias("manufacturer"), only("ru_number", F.col("tax") != 0).alias("ru_number"),
        only("price", F.col("tax") != 0.08).alias("price"), only("quantity", F.col("quantity") != 50).alias("quantity"),
        (F.col("total") * (1 + F.col("tax"))).alias("total"),
    ))


@query("op.source_stats", f"""
WITH {POSITION_SQL}, s AS (SELECT CASE WHEN line <> 1 THEN ktru END AS ktru, CASE WHEN line <> 2 THEN nkmi END AS nkmi, name, price FROM positions),
c AS (SELECT count(*) AS positions, count(ktru) AS k, count(nkmi) AS m, count(name) AS n, count(price) AS p FROM s)
SELECT f AS field, v AS n, positions, round(100 * v / positions, 1) AS pct
FROM c, LATERAL (VALUES ('ktru', k), ('nkmi', m), ('name', n), ('price', p)) AS x(f, v)
""")
def source_stats(spark, sf_dir):
    rows = positions(spark, sf_dir).select(
        F.when(F.col("line") != 1, F.col("ktru")).alias("ktru"), F.when(F.col("line") != 2, F.col("nkmi")).alias("nkmi"), "name", "price"
    )
    return rollups.coverage(rows, ["ktru", "nkmi", "name", "price"])


@query("op.share_of_total", """
WITH g AS (SELECT l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS money FROM lineitem GROUP BY 1)
SELECT flag, money, round(100 * money / sum(money) OVER (), 1) AS share FROM g
""")
def share_of_total(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(rollups.cents("l_extendedprice").alias("money"))
    return grouped.withColumn("share", ranking.share_of_total(grouped, "money"))


@query("op.report", f"""
WITH {POSITION_SQL}, {CONTRACT_SQL}
SELECT CAST(p.contract AS VARCHAR) AS reestr_number, strftime(o_orderdate, '%d.%m.%Y') AS concluded, o_orderstatus AS stage, c_name AS customer,
       declarant AS supplier, CAST(p.inn AS VARCHAR) AS supplier_inn, p.name, p.ktru, CAST(p.nkmi AS VARCHAR) AS nkmi,
       CAST(p.ru_number AS VARCHAR) AS ru_number, CASE WHEN p.line <> 7 THEN p.manufacturer ELSE '—' END AS manufacturer,
       p.price, p.quantity, p.total, g.nmck, CASE WHEN g.bidding = '—' THEN CAST(g.raw_pct AS VARCHAR) ELSE g.bidding END AS discount_cell,
       CASE WHEN p.line = 7 THEN 'yellow' ELSE '' END AS fill
FROM positions p JOIN orders ON p.contract = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN graded g ON g.contract = p.contract
""")
def report(spark, sf_dir):
    """Texts are tidied in the tables that hold each once, before they are joined to the lines; numbers need no tidying."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", N.or_dash(F.col("c_name")).alias("customer"))
    graded = contracts(spark, sf_dir).select(F.col("contract").alias("g"), "nmck", "bidding", "raw_pct")
    lines = positions(spark, sf_dir, tidy=N.or_dash)
    rows = lines.join(orders, F.col("contract") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(graded, F.col("contract") == F.col("g"))
    maker = F.when(F.col("line") != 7, F.col("manufacturer"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(N.DASH))
    return rows.select(
        number("contract").alias("reestr_number"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("concluded"), F.col("o_orderstatus").alias("stage"),
        "customer", F.col("declarant").alias("supplier"), number("inn").alias("supplier_inn"), "name", "ktru", number("nkmi").alias("nkmi"),
        number("ru_number").alias("ru_number"), F.coalesce(maker, F.lit(N.DASH)).alias("manufacturer"), "price", "quantity", "total", "nmck",
        F.when(F.col("bidding") == "—", F.col("raw_pct").cast("string")).otherwise(F.col("bidding")).alias("discount_cell"),
        cell_class(maker, F.lit(True), F.lit(True)).alias("fill"),
    )


def cell_class(value, clue, from_number):
    """How a report's cell is marked: blank cells are yellow with a clue and red without, values not from the contract's own number yellow."""
    return F.when(value.isNull(), F.when(clue, "yellow").otherwise("red")).when(~from_number, "yellow").otherwise("")


@query("op.cell_class", f"""
WITH {POSITION_SQL}
SELECT fill, count(*) AS n FROM (
  SELECT CASE WHEN line = 7 THEN CASE WHEN tax > 0.04 THEN 'yellow' ELSE 'red' END WHEN quantity > 25 THEN 'yellow' ELSE '' END AS fill FROM positions) GROUP BY 1
""")
def cell_classes(spark, sf_dir):
    fill = cell_class(F.when(F.col("line") != 7, F.col("manufacturer")), F.col("tax") > 0.04, F.col("quantity") <= 25)
    return positions(spark, sf_dir).select(fill.alias("fill")).groupBy("fill").agg(F.count("*").alias("n"))


@query("op.calibration_gate", r"""
WITH a AS (SELECT source, CASE WHEN (CASE WHEN regexp_matches(text, '[*%$#|]') THEN 0 ELSE 1 END) = quality THEN 1 ELSE 0 END AS ok FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) AS tn, sum(ok) AS tr FROM a)
SELECT source, count(*) AS n, CAST(sum(ok) AS BIGINT) AS n_right, round(sum(ok) / count(*), 4) AS accuracy,
       count(*) >= 10 AND sum(ok) / count(*) < 0.9 AS blocked, (SELECT tn >= 20 AND tr / tn < 0.95 FROM t) AS stop_all
FROM a GROUP BY 1
""")
def calibration_gate(spark, sf_dir):
    said = F.when(F.col("text").rlike(r"[*%$#|]"), 0).otherwise(1)
    answers = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rollups.calibration_gate(answers.select("source", F.when(said == F.col("quality"), 1).otherwise(0).alias("right")), "source")


@query("op.ewma", """
WITH o AS (SELECT user_id, list(greatest(0.4, least(40.0, value)) ORDER BY ts, event_id) AS vs, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(vs, lambda a, x: a * 0.7 + x * (1 - 0.7), 3.0), 6) AS average, n FROM o
""")
def ewma(spark, sf_dir):
    return rollups.moving_average(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("op.check_codes", f"""
WITH {POSITION_SQL}, codes(code) AS (VALUES ('ECONOMY'), ('PROMO'), ('NONE')),
k AS (SELECT DISTINCT ktru, contract, o_orderdate FROM positions JOIN orders ON contract = o_orderkey)
SELECT code, count(ktru) > 0 AS known, count(DISTINCT contract) FILTER (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') AS in_period,
       count(DISTINCT contract) AS ever,
       CASE WHEN count(ktru) = 0 THEN 'no such code' WHEN count(DISTINCT contract) FILTER (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') = 0 THEN 'none in the period' ELSE '' END AS note
FROM codes LEFT JOIN k ON code = ktru GROUP BY 1
""")
def check_codes(spark, sf_dir):
    codes = spark.createDataFrame([("ECONOMY",), ("PROMO",), ("NONE",)], "code string")
    seen = positions(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("contract") == F.col("o_orderkey"))
    inside = (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    counted = seen.filter(F.col("ktru").isin("ECONOMY", "PROMO", "NONE")).groupBy("ktru").agg(F.count_distinct(F.when(inside, F.col("contract"))).alias("p"), F.count_distinct("contract").alias("e"))
    joined = codes.join(counted, F.col("code") == F.col("ktru"), "left")
    period, ever = F.coalesce("p", F.lit(0)), F.coalesce("e", F.lit(0))
    note = F.when(F.col("ktru").isNull(), "no such code").when(period == 0, "none in the period").otherwise("")
    return joined.select("code", F.col("ktru").isNotNull().alias("known"), period.alias("in_period"), ever.alias("ever"), note.alias("note"))
