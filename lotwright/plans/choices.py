"""Queries that choose and combine rows: dedupe, top rows, set operations, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, select
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


@query("op.first_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_wins(spark, sf_dir):
    return ranking.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("op.last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, sf_dir):
    return ranking.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("op.most_common", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1
""")
def most_common(spark, sf_dir):
    return ranking.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("op.best_of", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1")
def best_of(spark, sf_dir):
    return ranking.best_of(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), "event_id", ["event_id", "value"])


@query("op.top_n_by_freq", """
WITH c AS (SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1)
SELECT p_type, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS place FROM c
""")
def top_n_by_freq(spark, sf_dir):
    return ranking.by_frequency(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("op.head_n_per_group", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def head_n_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return ranking.head_per_group(rows, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)


@query("op.sort_multi", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY (o_orderpriority = '5-LOW'), o_orderdate DESC, o_orderkey LIMIT 60")
def sort_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return rows.orderBy(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").desc(), "o_orderkey").limit(60)


@query("op.limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


@query("op.running_total_evict", """
WITH m AS (SELECT user_id, event_id, value, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id) AS t,
                  coalesce(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events)
SELECT user_id, event_id, value FROM m WHERE t > 400 AND b < t - 0.8 * 400
""")
def running_total_evict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", F.col("value").cast("decimal(18,2)").alias("size"))
    return ranking.evicted(rows, ["user_id"], "size", ["ts", "event_id"], 400, 0.8).select("user_id", "event_id", "value")


@query("op.ttl_filter", """
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - CASE WHEN event_type = 'error' THEN INTERVAL 15 DAY / 4 ELSE INTERVAL 15 DAY END
""".replace("INTERVAL 15 DAY / 4", "INTERVAL 90 HOUR"))
def ttl_filter(spark, sf_dir):
    now, life = F.lit("2024-01-31 00:00:00").cast("timestamp"), F.expr("INTERVAL 15 DAY")
    alive = F.col("ts") >= now - F.when(F.col("event_type") == "error", F.expr("INTERVAL 90 HOUR").cast("interval day to second")).otherwise(life.cast("interval day to second"))
    return table(spark, sf_dir, "events").filter(alive).select("event_id", "event_type")


@query("op.union", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def union(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return done.unionByName(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))


@query("op.distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").distinct()


@query("op.except", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def without(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("op.intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect(spark, sf_dir):
    of = lambda flag: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return of("R").intersect(of("A"))


@query("op.sweep", f"""
WITH {POSITION_SQL}, seen AS (SELECT DISTINCT contract FROM positions WHERE name = 'red widget'),
codes AS (SELECT ktru, count(*) AS n FROM positions WHERE contract IN (SELECT contract FROM seen) AND name = 'red widget' GROUP BY 1 ORDER BY n DESC, ktru LIMIT 3)
SELECT contract, line, name, ktru FROM positions WHERE ktru IN (SELECT ktru FROM codes) AND contract NOT IN (SELECT contract FROM seen) AND name LIKE 'red%'
""")
def sweep(spark, sf_dir):
    rows = positions(spark, sf_dir).select("contract", "line", "name", "ktru")
    wave = rows.filter(F.col("name") == "red widget")
    codes = wave.groupBy("ktru").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ktru").limit(3).select("ktru")
    found = rows.filter(F.col("name").startswith("red")).join(codes, "ktru", "left_semi")
    return found.join(wave.select("contract").distinct(), "contract", "left_anti").select("contract", "line", "name", "ktru")


@query("op.snapshot_diff", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 333 <> 0)
SELECT *, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def snapshot_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.filter("o_orderkey % 333 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")))
    return ranking.snapshot_diff(old, new)


@query("op.stratified_sample", """
WITH t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS turn FROM documents)
SELECT lang, doc_id, turn FROM t ORDER BY turn, lang LIMIT 30
""")
def stratified_sample(spark, sf_dir):
    return ranking.round_robin(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", [F.col("doc_id").desc()], 30).select("lang", "doc_id", "turn")


@query("op.scan_contracts_by_code", f"""
WITH {POSITION_SQL}
SELECT contract, o_orderdate, o_orderstatus, line FROM positions JOIN orders ON contract = o_orderkey
WHERE ktru IN ('PROMO', 'ECONOMY') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus IN ('F', 'O')
QUALIFY row_number() OVER (PARTITION BY contract ORDER BY line, ru_number, inn, total) = 1
""")
def scan_contracts_by_code(spark, sf_dir):
    rows = positions(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("contract") == F.col("o_orderkey"))
    found = select.scan_by_code(rows, ["PROMO", "ECONOMY"], "o_orderdate", "1996-01-01", "1996-12-31", "o_orderstatus", ["F", "O"])
    order = [F.col(c) for c in ("line", "ru_number", "inn", "total")]
    return ranking.first_wins(found, ["contract"], order).select("contract", "o_orderdate", "o_orderstatus", "line")


@query("op.scan_contracts_by_text", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'released')")
def scan_contracts_by_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(select.has_words(F.col("text"), ["license", "Released"])).select("doc_id", "lang", "n_chars")


@query("op.union_dedupe_contracts", """
WITH u AS (SELECT 0 AS query_no, doc_id, source FROM documents WHERE contains(lower(text), 'license') UNION ALL
           SELECT 1, doc_id, source FROM documents WHERE lang = 'de' UNION ALL SELECT 2, doc_id, source FROM documents WHERE source = 'src1')
SELECT query_no, doc_id, source FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_no) = 1
""")
def union_dedupe_contracts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    of = lambda keep: docs.filter(keep).select("doc_id", "source")
    found = select.union_first([of(select.has_words(F.col("text"), ["license"])), of(F.col("lang") == "de"), of(F.col("source") == "src1")], "doc_id", "doc_id")
    return found.select("query_no", "doc_id", "source")


@query("op.count_queries", """
SELECT word, count(*) FILTER (contains(lower(text), word)) AS n, count(*) FILTER (contains(lower(text), word)) > 200 AS over_cap
FROM documents, (VALUES ('license'), ('the'), ('password'), ('nothing like it')) AS w(word) GROUP BY word
""")
def count_queries(spark, sf_dir):
    words = ["license", "the", "password", "nothing like it"]
    low = F.lower("text")
    counted = table(spark, sf_dir, "documents").agg(*[F.count(F.when(low.contains(w), 1)).alias(f"w{i}") for i, w in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)])
    return counted.select(F.explode(pairs).alias("p")).select("p.word", "p.n", (F.col("p.n") > 200).alias("over_cap"))


@query("op.collect_rows", f"""
WITH {POSITION_SQL}, b AS (SELECT contract, line, ru_number, CASE WHEN line % 3 <> 0 THEN ktru END AS ktru, name FROM positions)
SELECT contract, line, ru_number, ktru, name, 'code' AS by FROM b WHERE ktru = 'PROMO'
UNION ALL SELECT contract, line, ru_number, ktru, name, 'name' FROM b x WHERE ktru IS NULL AND EXISTS (SELECT 1 FROM b y WHERE y.ktru = 'PROMO' AND y.contract = x.contract AND y.name = x.name)
""")
def collect_rows(spark, sf_dir):
    rows = positions(spark, sf_dir).select("contract", "line", "ru_number", F.when(F.col("line") % 3 != 0, F.col("ktru")).alias("ktru"), "name")
    return select.collect_rows(rows, ["PROMO"], "contract")


@query("op.plan_queries", """
SELECT place, kind, value FROM (VALUES (CAST(0 AS BIGINT), 'code', 'PROMO'), (1, 'code', 'SMALL'), (2, 'registration', 'R 1'), (3, 'word', 'Ajax'), (4, 'word', 'AJ15')) AS p(place, kind, value)
""")
def plan_queries(spark, sf_dir):
    planned = select.plan(select.Search(codes=["PROMO", "SMALL", "promo"], registrations=["R 1"], phrases=["Ajax AJ15", "ajax"]))
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(planned)], "place long, kind string, value string")


@query("op.streaming_progress", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_progress(spark, sf_dir):
    from ..streaming.progress import hourly

    return hourly(table(spark, sf_dir, "events"))
