"""Choosing rows: first and last of a key, the commonest, the best, the head of each group.

Orders are total where the callers' order columns are, so results don't depend on
partitioning. Ties that a plain program breaks by insertion are broken by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows of equal key the first in order."""
    return head_per_group(df, keys, order, 1)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of equal key the last in order."""
    return head_per_group(df, keys, [F.col(c).desc() for c in order], 1)


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")


def most_common(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The commonest value of each key, the first seen of equals, with its count.

    Counting comes first, so a key of many rows is a few partial rows when it is shuffled.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = F.max_by(F.struct(F.col(value), F.col("n")), F.struct(F.col("n"), -F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(*keys, f"_best.{value}", "_best.n")


def best_of(df: DataFrame, keys: list[str], score: Column, position: str, columns: list[str]) -> DataFrame:
    """The row of the highest score of each key, the first of equals."""
    best = F.max_by(F.struct(*columns), F.struct(score, -F.col(position)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[f"_best.{c}" for c in columns])


def by_frequency(df: DataFrame, value: str, position: str) -> DataFrame:
    """Values with their counts and place: the commonest first, the first seen of equals."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_seen")).cast("long"))


def share_of_total(df: DataFrame, amount: str) -> Column:
    """An amount's part of the total of all rows, in percent to one digit."""
    return F.round(100 * F.col(amount) / F.sum(amount).over(Window.partitionBy()), 1)


def evicted(df: DataFrame, keys: list[str], size: str, order: list[str], cap: float, keep: float) -> DataFrame:
    """The oldest rows of each key that go so that what stays is at most keep * cap, if the key is above the cap."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size).over(Window.partitionBy(*keys))
    marked = df.withColumn("_total", total).withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return marked.filter((F.col("_total") > cap) & (F.col("_before") < F.col("_total") - keep * cap)).drop("_total", "_before")


def round_robin(df: DataFrame, group: str, order: list[Column], rows: int) -> DataFrame:
    """`rows` rows, one of each group in turn. No group gives more than `rows`, so each task ranks that many of a group at most."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).filter(F.col("turn") <= rows).withColumn("turn", F.col("turn").cast("long")).orderBy("turn", group).limit(rows)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one snapshot that the other lacks, with the side they are on."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
