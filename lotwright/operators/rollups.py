"""Roll-ups of positions: market share, discounts, coverage, remarks.

Money is summed as decimals, so sums don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import normalise as N
from ..functions import prices
from .ranking import share_of_total


def cents(c: Column | str) -> Column:
    """Exact sum of money as a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.coalesce(c, F.lit(0.0)).cast("decimal(18,2)")).cast("double")


def producers(positions: DataFrame, title: str = "manufacturer") -> DataFrame:
    """Positions, contracts, units, money, share and price spread by producer; a lone declarant is named."""
    grouped = positions.groupBy(F.coalesce(F.col(title), F.lit("")).alias("producer")).agg(
        F.count("*").alias("positions"),
        F.count_distinct("contract").alias("contracts"),
        F.sum("quantity").cast("double").alias("units"),
        cents("total").alias("money"),
        F.round(F.median("price"), 4).alias("median_price"),
        F.min("price").alias("least_price"),
        F.max("price").alias("most_price"),
        F.count_distinct("declarant").alias("declarants"),
        F.when(F.count_distinct("declarant") == 1, F.max("declarant")).alias("declarant"),
    )
    return grouped.withColumn("share", share_of_total(grouped, "money"))


def summary(positions: DataFrame) -> DataFrame:
    """One row over all positions."""
    share = lambda c: F.round(100 * F.count(c) / F.count("*"), 0).cast("long")
    return positions.agg(
        F.count("*").alias("positions"),
        F.count_distinct("contract").alias("contracts"),
        F.count("manufacturer").alias("with_manufacturer"),
        share("manufacturer").alias("with_manufacturer_pct"),
        F.count("ru_number").alias("with_ru"),
        share("ru_number").alias("with_ru_pct"),
        F.count_distinct("manufacturer").alias("producers"),
        F.count_distinct("supplier").alias("suppliers"),
        F.count_distinct("customer").alias("customers"),
        cents("total").alias("money"),
        F.date_format(F.min("date"), "dd.MM.yyyy").alias("first_date"),
        F.date_format(F.max("date"), "dd.MM.yyyy").alias("last_date"),
    )


def discount_stats(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Median of reductions above zero, the largest, and counts, over contracts with columns bidding, percent and why."""
    lowered = F.when(F.col("percent") > 0, F.col("percent"))
    return contracts.groupBy(*keys).agg(
        F.round(F.median(lowered), 4).alias("median_pct"),
        F.max("percent").alias("most_pct"),
        F.count(lowered).alias("lowered"),
        F.count("percent").alias("known"),
        F.count("*").alias("contracts"),
        F.count(F.when(F.col("bidding").isin(prices.NO_BIDDING, prices.SMALL_VOLUME), 1)).alias("no_bidding"),
        F.count(F.when(F.col("why") != "", 1)).alias("incomparable"),
    )


def remarks(positions: DataFrame) -> DataFrame:
    """Data-quality counters of all positions."""
    off = F.abs(F.col("price") * F.col("quantity") - F.col("total")) > F.greatest(F.lit(1.0), 0.01 * F.abs("total"))
    return positions.agg(
        F.count(F.when(F.col("manufacturer").isNull(), 1)).alias("no_manufacturer"),
        F.count(F.when(F.col("ru_number").isNull(), 1)).alias("no_ru"),
        F.count(F.when(F.col("price").isNull(), 1)).alias("no_price"),
        F.count(F.when(F.col("quantity").isNull(), 1)).alias("no_quantity"),
        F.count(F.when(off, 1)).alias("off_sum"),
    )


def coverage(positions: DataFrame, fields: list[str]) -> DataFrame:
    """How many positions have each field, as a long table."""
    counted = positions.agg(F.count("*").alias("positions"), *[F.count(c).alias(c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])
    return counted.select("positions", F.explode(pairs).alias("f")).select(
        "f.field", "f.n", "positions", F.when(F.col("positions") > 0, F.round(100 * F.col("f.n") / F.col("positions"), 1)).alias("pct")
    )


def calibration_gate(answers: DataFrame, group: str, *, least: int = 10, wanted: float = 0.9, least_all: int = 20, wanted_all: float = 0.95) -> DataFrame:
    """Accuracy of graded answers (right: 0 or 1) by group; a weak group is blocked, weak answers overall stop all."""
    by_group = answers.groupBy(group).agg(F.count("*").alias("n"), F.sum("right").cast("long").alias("n_right"))
    total = answers.agg(F.count("*").alias("_n"), F.sum("right").cast("long").alias("_r"))
    accuracy = F.col("n_right") / F.col("n")
    return by_group.crossJoin(F.broadcast(total)).select(  # the total is one row
        group, "n", "n_right", F.round(accuracy, 4).alias("accuracy"),
        ((F.col("n") >= least) & (accuracy < wanted)).alias("blocked"),
        ((F.col("_n") >= least_all) & (F.col("_r") / F.col("_n") < wanted_all)).alias("stop_all"),
    )


def registry_gaps(positions: DataFrame, name: str, record: str, record_name: str) -> DataFrame:
    """How many positions have no record, and how many one whose name neither equals theirs nor shares a designation with it."""
    found = F.col(record).isNotNull()
    agrees = (N.name_key(F.col(name)) == N.name_key(F.col(record_name))) | E.shares_mark(F.col(name), F.col(record_name))
    return positions.agg(
        F.count("*").alias("positions"), F.count(F.when(~found, 1)).alias("without_manufacturer"), F.count(F.when(found & ~agrees, 1)).alias("mismatched")
    )


def moving_average(samples: DataFrame, keys: list[str], order: list[str], value: str, *, span: str = "day", start: float = 3.0, keep: float = 0.7, low: float = 0.4, high: float = 40.0) -> DataFrame:
    """Exponentially weighted average of clamped values in order, from `start`; the first of `order` is a time.

    The average is linear in the values, so the values of a `span` of time are one
    partial sum, and those follow each other: no task holds more of a key than that.
    """
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))).alias("_v")
    block = F.date_trunc(span, F.col(order[0])).alias("_b")
    ordered = F.array_sort(F.collect_list(F.struct(*order, clamped)))
    partial = F.aggregate(ordered, F.lit(0.0), lambda a, x: a * keep + x["_v"] * (1 - keep))
    blocks = samples.groupBy(*keys, block).agg(partial.alias("_s"), F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct("_b", "_s", "_n")))
    folded = F.aggregate(parts, F.lit(start), lambda a, x: a * F.pow(F.lit(keep), x["_n"]) + x["_s"])
    return blocks.groupBy(*keys).agg(F.round(folded, 6).alias("average"), F.sum("_n").alias("n"))
