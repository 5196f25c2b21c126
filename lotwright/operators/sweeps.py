"""Second waves of a search, and plans of many searches, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import normalise as N
from ..sources.stored import store

DISCOVER = 60


@dataclass
class Sweep:
    """found: rows of the second wave; codes: (code, wave, contracts, fresh) of what it asked for; looked: how many earlier contracts were read, and of how many."""

    found: DataFrame
    codes: DataFrame
    looked: DataFrame


def sweep(rows: DataFrame, matches: Column, *, day: str, begins: Column, asked: list[str] = (), discover: int = DISCOVER) -> Sweep:
    """Rows of the period that the codes of matching rows lead to, in contracts without a match of their own.

    `rows` have contract, code, object and `day`. The first wave are matching rows from
    `begins` on. Their codes are asked for, and those of matching rows in `discover`
    earlier contracts: supplies ahead of services, then the latest. Rows of these codes in
    other contracts of the period are found where they match; earlier rows give codes alone.
    """
    marked = rows.withColumn("_match", F.coalesce(matches, F.lit(False)))
    period, before = marked.filter(F.col(day) >= begins), marked.filter(F.col(day) < begins)
    wave = period.filter("_match")
    seen = store(wave.select("contract").distinct(), "sweep-seen")
    known = F.col("code").isNotNull() & ~F.col("code").isin(*asked) if asked else F.col("code").isNotNull()
    first = wave.filter(known).select("code").distinct().withColumn("wave", F.lit(1))
    early = before.filter("_match").join(seen, "contract", "left_anti")
    heads = early.groupBy("contract").agg(F.min(I.is_service(F.col("object")).cast("int")).alias("service"), F.max(day).alias("day"))
    # a cap on the contracts that are read for codes, which `looked` tells
    chosen = store(heads.orderBy("service", F.desc("day"), "contract").limit(discover).select("contract"), "sweep-chosen")
    second = early.join(chosen, "contract", "left_semi").filter(known & ~I.is_service(F.col("object"))).select("code").distinct().withColumn("wave", F.lit(2))
    codes = store(first.union(second).groupBy("code").agg(F.min("wave").alias("wave")), "sweep-codes")
    of_codes = period.join(codes.select("code"), "code", "left_semi")
    fresh = of_codes.join(seen, "contract", "left_anti")
    counts = of_codes.groupBy("code").agg(F.count_distinct("contract").alias("contracts"))
    new = fresh.groupBy(F.col("code").alias("c")).agg(F.count_distinct("contract").alias("fresh"))
    report = codes.join(counts, "code", "left").join(new, F.col("code") == F.col("c"), "left").select("code", "wave", F.coalesce("contracts", F.lit(0)).alias("contracts"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    of = heads.agg(F.count("*").alias("of")).withColumn("looked", F.least("of", F.lit(discover)))
    return Sweep(fresh.filter("_match").select(*rows.columns), report, of.select("looked", "of"))


def plans(searches: DataFrame) -> DataFrame:
    """(q, place, kind, value): the scans of each search in order, each once whatever its case.

    `searches` have q, the arrays codes, registrations and phrases, and only_codes. A
    search within its codes asks for those alone; a phrase is asked for word by word.
    """
    some = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: N.blank_to_null(v).isNotNull())
    scan = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    words = F.filter(F.flatten(F.transform(some("phrases"), lambda p: F.split(F.trim(p), r"\s+"))), lambda w: w != "")
    rest = F.concat(F.transform(some("registrations"), scan("registration")), F.transform(words, scan("word")))
    codes = F.transform(some("codes"), scan("code"))
    inside = F.coalesce("only_codes", F.lit(False)) & (F.size(codes) > 0)
    every = F.when(inside, codes).otherwise(F.concat(codes, rest))
    low = lambda s: F.struct(s["kind"], F.lower(s["value"]))
    once = N.let(every, lambda ss: F.filter(ss, lambda s, i: F.array_position(F.transform(ss, low), low(s)) == i + 1))
    return searches.select("q", F.posexplode(once).alias("place", "s")).select("q", F.col("place").cast("long").alias("place"), "s.kind", "s.value")
