"""Exact dedup by content-defined chunk recipes.

A text without white space is cut where its own content says so: after the first
sentence mark that follows at least CHUNK_LEAST characters, or after CHUNK_MOST
characters. A chunk's identifier is its SHA-256 digest with its length; the chunk
dictionary groups all occurrences of an identifier and verifies it by a second,
independent 64-bit hash, which must be one and the same for all of them. A document
becomes a recipe, the ordered list of its chunks' identifiers. Equal recipes mean
equal texts, so documents are compared, grouped and shuffled as recipe keys and
never as texts. A document that holds an identifier that fails its verification is
grouped by its text itself.

All of it is DataFrame code. Grouping uses aggregates that are combined before the
shuffle, so a group of copies of any size passes as one partial row a task.

Defined cases: a null text is an empty one, its recipe an empty list; all empty texts
are equal; ties in length keep the smallest doc_id, null ids last; repeated rows are
members of their group like any others, and one row of a group is kept; a very long
text has a long recipe, which stays in its row and is shuffled as one digest, chunk by
chunk only for the dictionary; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_LEAST = 1024
CHUNK_MOST = 8192


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    bare = F.coalesce(text, F.lit(""))
    for space in common.SPACES:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    return bare


def chunks(bare: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    pattern = rf"(?s).{{{CHUNK_LEAST - 1},{CHUNK_MOST - 1}}}?[.!?]|.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(bare, F.lit(pattern), F.lit(0))


def _with_recipe(docs: DataFrame) -> DataFrame:
    """doc_id, row, points, text_sha256, recipe (chunk ids) and seals (second hashes)."""
    bare = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised(F.col("text")).alias("bare"))
    cut = bare.withColumn("parts", chunks(F.col("bare")))
    identifier = lambda c: F.concat(F.sha2(c, 256), F.lit(":"), F.length(c))
    return cut.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "points", F.sha2("bare", 256).alias("text_sha256"),
        F.transform("parts", identifier).alias("recipe"), F.transform("parts", lambda c: F.xxhash64(c)).alias("seals"),
    )


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """chunk_id, occurrences and whether one second hash seals all of them."""
    pieces = recipes.select(F.explode(F.arrays_zip("recipe", "seals")).alias("c")).select(F.col("c.recipe").alias("chunk_id"), F.col("c.seals").alias("seal"))
    return pieces.groupBy("chunk_id").agg(F.count("*").alias("occurrences"), (F.min("seal") == F.max("seal")).alias("verified"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, points, text_sha256, n_chunks, keep_id, group_size and kept of every row.

    Of a group, the row with the most code points in the original text stays, then
    that with the smallest doc_id.
    """
    recipes = common.store(_with_recipe(docs), "exact-recipe")
    doubtful = common.store(chunk_dictionary(recipes).filter("not verified").select("chunk_id"), "exact-doubt")
    keyed = recipes.select(
        "doc_id", "row", "points", "text_sha256", F.size("recipe").alias("n_chunks"), F.sha2(F.array_join("recipe", ","), 256).alias("key"), "recipe"
    )
    if doubtful.isEmpty():
        keyed = keyed.drop("recipe")
    else:
        holders = keyed.select("doc_id", "key", F.explode("recipe").alias("chunk_id")).join(doubtful, "chunk_id", "left_semi").select("key").distinct()
        marked = holders.withColumn("unsure", F.lit(True))
        keyed = keyed.drop("recipe").join(marked, "key", "left").withColumn("key", F.when(F.col("unsure"), F.concat("key", "text_sha256")).otherwise(F.col("key"))).drop("unsure")
    # min of (-points, id is null, id, row): the longest, then the smallest id
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row").alias("r")))
    # stored, so that both sides of the join are plain shuffles, whose large groups Spark splits
    groups = common.store(keyed.groupBy("key").agg(first.alias("best"), F.count("*").alias("group_size")), "exact-group")
    return keyed.join(groups, "key").select(
        "doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "text_sha256", "n_chunks", "points"
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with its columns.

    Ids are joined to texts only here. Where an id occurs more than once, the longest
    of its rows with the text stays.
    """
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_key"))
    return common.kept_rows(docs, common.store(stay, "exact-stay"), F.sha2(normalised(F.col("text")), 256), "exact")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact groups of all documents.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    return exact_groups(common.documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(bare) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY bare ORDER BY length(t) DESC, doc_id)
"""
