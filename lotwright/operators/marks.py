"""Marks of positions: tidied, dropped with a reason, filled from the registry, and spelled alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import companies as C
from ..functions import marks as M
from ..functions import names
from ..functions import normalise as N
from .ranking import most_common


def tidied(rows: DataFrame, mark: str, manufacturer: str) -> DataFrame:
    """`rows` with their marks tidied, and `dropped`, the reason where one is none; such marks are null."""
    tidy = M.tidy_mark(F.col(mark))
    told = rows.withColumn("_tidy", F.when(F.col(mark).isNotNull(), tidy))
    why = F.when(F.col("_tidy").isNotNull(), M.why_no_mark(F.col("_tidy"), F.col(manufacturer)))
    told = told.withColumn("dropped", why)
    return told.withColumn(mark, F.when(F.col("dropped").isNull(), F.col("_tidy"))).drop("_tidy")


def reasons(told: DataFrame) -> DataFrame:
    """(dropped, n): how many marks each reason dropped."""
    return told.filter("dropped is not null").groupBy("dropped").agg(F.count("*").alias("n"))


def samples(told: DataFrame, original: str, order: list[str], most: int = 40) -> DataFrame:
    """The first `most` marks that each reason dropped, for the report's notes; (dropped, original, order)."""
    place = F.row_number().over(Window.partitionBy("dropped").orderBy(*order))
    picked = told.filter("dropped is not null").select("dropped", original, *order)
    return picked.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def spelled_alike(rows: DataFrame, mark: str, position: str) -> DataFrame:
    """`rows` with each mark in the commonest spelling of its key, the first seen of equals."""
    keyed = rows.withColumn("_key", N.mark_key(F.col(mark)))
    best = most_common(keyed.filter(F.col("_key") != ""), ["_key"], mark, position).select(F.col("_key").alias("_k"), F.col(mark).alias("_best"))
    joined = keyed.join(best, F.col("_key") == F.col("_k"), "left")
    return joined.withColumn(mark, F.coalesce("_best", mark)).drop("_key", "_k", "_best")


def refined(rows: DataFrame, mark: str, companies: Column) -> DataFrame:
    """`rows` whose marks lose the name of their own company; a mark that is nothing else, or no mark after that, is null."""
    cores = F.flatten(F.transform(F.filter(companies, lambda n: n.isNotNull()), C.company_keys))
    cut = M.without_company_tail(F.col(mark), F.filter(companies, lambda n: n.isNotNull()))
    held = lambda c: F.exists(cores, lambda k: F.contains(N.company_core(c), k))
    return rows.withColumn(mark, F.when(~held(F.col(mark)), F.col(mark)).when(~held(cut) & (cut != ""), cut))


def from_registry(rows: DataFrame, mark: str, record_name: str, hints: Column, usable: Column) -> DataFrame:
    """`rows` without a mark get the one that their record's name gives, unless that lists several; `filled` marks them."""
    known = F.col(mark).isNull() & F.col(record_name).isNotNull() & usable & ~M.lists_several(F.col(record_name))
    said = names.parse_name(F.col(record_name), hints)["full"]
    told = rows.withColumn("_said", F.when(known, said))
    good = (F.col("_said") != "") & ~C.is_company_name(F.col("_said"), F.lit(""))
    told = told.withColumn("filled", F.coalesce(known & good, F.lit(False)))
    return told.withColumn(mark, F.when(F.col("filled"), F.col("_said")).otherwise(F.col(mark))).drop("_said")


def confirmed_kinds(seen: DataFrame, kind: str, code: str, contract: str) -> DataFrame:
    """(kind, code, confirmed, found, note): whether contracts under a code name the kind it is asked for.

    `seen` has a row for each pair that is asked for, with `said`, the kind that a
    contract's position names (null if none).
    """
    said = F.col("said")
    told = seen.groupBy(kind, code).agg(
        F.count(F.when(said == F.col(kind), 1)).alias("_same"), F.min(F.when(said != F.col(kind), said)).alias("_other"), F.count_distinct(F.when(said.isNotNull(), F.col(contract))).alias("contracts")
    )
    same, other = F.col("_same") > 0, F.col("_other").isNotNull()
    return told.select(
        kind, code, "contracts", F.when(same, True).when(other, False).alias("confirmed"), F.when(same, F.col(kind)).otherwise(F.col("_other")).alias("found"),
        F.when(same, "вид подтверждён контрактом").when(other, F.concat(F.lit("в контрактах по этому коду стоит вид "), F.col("_other").cast("string"))).otherwise("в контрактах код вида не указан — проверить не по чему").alias("note"),
    )
