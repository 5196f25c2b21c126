"""The driver's tables as contracts, positions and a registry.

An order stands for a contract, its lines for positions, a part for a registry
record: part key for the registration number, brand for the producer, type for the
catalogue code, size for the device kind; a supplier for the declarant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices
from ..sources.tables import table

#: What stands for the way of placing: single supplier, and a purchase of small volume.
NO_BIDDING_WAY, SMALL_WAY = "1-urgent", "5-low"

POSITION_SQL = """
positions AS (
  SELECT l_orderkey AS contract, l_linenumber AS line, l_suppkey AS inn, p_type AS ktru, p_size AS nkmi, p_name AS name,
         l_partkey AS ru_number, p_brand AS manufacturer, s_name AS declarant,
         l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS total, l_tax AS tax,
         l_shipdate AS shipped
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""

CONTRACT_SQL = """
start AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS nmck FROM lineitem GROUP BY 1),
contracts AS (
  SELECT o_orderkey AS contract, o_orderstatus AS stage, o_orderpriority AS way, o_totalprice AS price, nmck,
         CASE WHEN nmck <> 0 THEN round(100 * (nmck - o_totalprice) / nmck, 2) END AS raw_pct,
         CASE WHEN o_totalprice > nmck THEN 'цена контракта выше начальной — сравнивать не с чем' ELSE '' END AS why
  FROM orders LEFT JOIN start ON o_orderkey = l_orderkey),
graded AS (
  SELECT *, CASE WHEN lower(way) LIKE '%1-urgent%' THEN 'торгов не было' WHEN why <> '' THEN why
                 WHEN nmck IS NULL THEN 'начальная цена не найдена'
                 WHEN raw_pct = 0 AND lower(way) LIKE '%5-low%' THEN 'торгов не было: закупка малого объёма' ELSE '—' END AS bidding
  FROM contracts)
"""


def positions(spark: SparkSession, sf_dir: str, tidy: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines with their record and declarant. Part and supplier are joined by key; Spark broadcasts them if their size allows.

    `tidy` is applied to the texts of both before the join, once a record and not once a line.
    """
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    if tidy is not None:
        part = part.withColumns({c: tidy(F.col(c)) for c in ("p_name", "p_type", "p_brand")})
        supplier = supplier.withColumn("s_name", tidy(F.col("s_name")))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("l_orderkey").alias("contract"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("inn"),
        F.col("p_type").alias("ktru"), F.col("p_size").alias("nkmi"), F.col("p_name").alias("name"),
        F.col("l_partkey").alias("ru_number"), F.col("p_brand").alias("manufacturer"), F.col("s_name").alias("declarant"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("total"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("shipped"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sum of their lines as starting price, graded for bidding and price reduction."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    start = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("nmck"))
    joined = orders.join(start, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("contract"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("way"),
        F.col("o_totalprice").alias("price"), "nmck",
    )
    never = F.lit(False)
    note = prices.no_bidding_note(F.col("way"), never, F.lit(""), F.col("nmck"), F.col("price"), none=NO_BIDDING_WAY, small=SMALL_WAY)
    return joined.select(
        "*", prices.raw_percent(F.col("nmck"), F.col("price")).alias("raw_pct"),
        prices.incomparable(never, F.lit(""), F.col("nmck"), F.col("price")).alias("why"), note.alias("bidding"),
    ).withColumn("percent", prices.discount_percent(F.col("bidding"), F.col("nmck"), F.col("price")))
