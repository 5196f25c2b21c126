"""Whether firms that share a key are one, by how their names sound.

The first firm of a key is compared with each other one, never all with all; a pair of
names that many keys have is compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..sources.stored import store
from .kinds import SAME_FIRM, SAME_FIRM_AND_NUMBER, likely_firms


def unanimous(donors: DataFrame, keys: list[str], value: str, position: str, number: str | None = None) -> DataFrame:
    """(keys, donated, companies): the first donor's value of each key, and 1 plus how many firms are unlike the first.

    Firms are one from a likeness of SAME_FIRM, or of SAME_FIRM_AND_NUMBER where all of a
    key's firms have one taxpayer `number`. Values that differ in quotes or legal form alone are one.
    """
    inn = N.blank_to_null(F.col(number).cast("string")) if number else F.lit(None).cast("string")
    known = donors.filter(N.blank_to_null(F.col(value)).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(position).alias("_p"), inn.alias("_inn"), N.producer_key(F.col(value)).alias("_firm"))
    firms = store(known.groupBy(*keys, "_firm").agg(F.min(F.struct("_p", "_v", "_inn")).alias("_first")), "firms")
    heads = firms.groupBy(*keys).agg(
        F.min("_first").alias("_head"), F.min_by("_firm", "_first").alias("_head_firm"),
        (F.count("*") == F.count("_first._inn")).alias("_numbered"), F.count_distinct("_first._inn").alias("_numbers"),
    )
    each = firms.join(heads, keys)
    apart = F.col("_firm") != F.col("_head_firm")
    near = store(likely_firms(each.filter(apart).select(F.col("_head._v").alias("one"), F.col("_first._v").alias("other"))), "firm-pairs")
    graded = each.join(near, (F.col("_head._v") == F.col("one")) & (F.col("_first._v") == F.col("other")), "left")
    limit = F.when(F.col("_numbered") & (F.col("_numbers") == 1), SAME_FIRM_AND_NUMBER).otherwise(SAME_FIRM)
    unlike = apart & (F.col("forth") < limit)
    return graded.groupBy(*keys).agg(F.first("_head._v").alias("donated"), (F.count(F.when(unlike, 1)) + 1).alias("companies"))
