"""What the corpus operators share: the word pattern, readers and durable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import discard, shared_folder, store

__all__ = ["discard", "shared_folder", "store"]

#: White space is exactly these six ASCII characters; a word is a run of others.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    while name in df.columns:
        name += "_"
    return name


def kept_rows(docs: DataFrame, stay: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows of `docs` that the stored table `stay` (k_id, k_key) names, one each, with the columns of `docs`.

    Texts are joined by id. Only rows whose id occurs more than once are told apart by
    `key`; of those alike in both, the one with the longest, then greatest text stays.
    """
    ids = docs.groupBy(F.col("doc_id").alias("r_id")).agg(F.count("*").alias("n")).filter("n > 1").select("r_id")
    ids = store(ids, f"{name}-repeat")
    if ids.isEmpty():
        return docs.join(stay, docs["doc_id"].eqNullSafe(stay["k_id"]), "left_semi")
    once = docs.join(ids, docs["doc_id"].eqNullSafe(ids["r_id"]), "left_anti")
    once = once.join(stay, once["doc_id"].eqNullSafe(stay["k_id"]), "left_semi")
    mark = fresh(docs, "key")
    repeated = docs.join(ids, docs["doc_id"].eqNullSafe(ids["r_id"]), "left_semi").withColumn(mark, key)
    repeated = repeated.join(stay, repeated["doc_id"].eqNullSafe(stay["k_id"]) & (repeated[mark] == stay["k_key"]), "left_semi")
    best = F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), F.col("text"))).alias("best")
    repeated = repeated.groupBy(F.col("doc_id").alias("k_id"), F.col(mark).alias("k_key")).agg(best).select("best.*")
    return once.unionByName(repeated)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
