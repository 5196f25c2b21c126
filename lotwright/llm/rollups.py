"""Token counts as rollups that deltas maintain.

A change is a signed row: +1 for a document that comes, -1 for one that goes, both
for one whose count is revised. A batch of changes is summed by source, language and
tokenizer version and written as one folder, named by the batch, of a ledger in
storage; a row in the ledger's list of commits then makes it count. Totals are sums
over the committed batches, which may come in any order. A batch that is committed
again changes nothing; a batch cut short does not count, and its next try replaces
what it left. No text or count is read again to keep totals current. A snapshot sums
the batches up to now, and totals are then those of the last whole snapshot and of the
batches that it does not cover. A ledger has one writer at a time.

Defined cases: a null text has no tokens but is a document; null sources and
languages are keys of their own; equal rows count each; groups that come to no
documents and no tokens are left out; a very long text is counted whole, in the batch
of texts that it comes in; a ledger without batches and a batch without rows give no
totals; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import slices

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, batch string"
COMMIT = "batch string"
TOTAL = "source string, lang string, tokenizer string, documents long, tokens long"
WHOLE = "number long"
RANKS = "byte_bpe_50k.tiktoken"
VERSIONS = {"words": "words-1", "bpe": "byte-bpe-50k-1"}

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens: a row for each document and tokenizer version.

    `ranks` is a rank file that is there on every executor.
    """

    @F.pandas_udf("long")
    def bpe(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        encoding = _encoding(ranks or public_tokenizers.path(RANKS))
        return pd.Series([len(encoding.encode_ordinary(t)) for _, run in slices(texts) for t in run], dtype="int64")

    counted = docs.select(
        "doc_id", "source", "lang",
        F.array(
            F.struct(F.lit(VERSIONS["words"]).alias("tokenizer"), common.word_count(F.col("text")).alias("tokens")),
            F.struct(F.lit(VERSIONS["bpe"]).alias("tokenizer"), bpe(F.coalesce("text", F.lit(""))).alias("tokens")),
        ).alias("counts"),
    )
    return counted.select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", "c.*")


def inserts(counts: DataFrame) -> DataFrame:
    """The changes that bring in counted documents."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """The changes that take out counted documents."""
    return counts.select(*KEY, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that put new counts in place of old ones."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """A ledger of batches in a folder that all executors share.

    `deltas` has a folder of summed changes for each batch, `commits` a row for each
    batch that is whole. A batch counts from the moment that its row is there, so one
    cut short, and then tried again, counts never or once. `snapshots` has numbered sums
    and the batches that each covers, `whole` the numbers of those that are whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("commits", COMMIT), ("deltas/none", DELTA), ("whole", WHOLE)):  # so that a ledger without batches can be read
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def committed(self) -> DataFrame:
        """The names of the batches that count."""
        return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Commit a batch; to commit a batch again changes nothing."""
        if not self.committed().filter(F.col("batch") == batch).isEmpty():
            return
        summed = changes.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        summed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.folder}/deltas/{quote(batch, safe='')}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.folder}/commits")

    def _snapshot(self) -> int:
        """The number of the last whole snapshot, 0 without one."""
        return self.spark.read.schema(WHOLE).parquet(f"{self.folder}/whole").agg(F.max("number")).first()[0] or 0

    def _summed(self, covered: int, batches: DataFrame) -> DataFrame:
        """Sums over a snapshot and those of the committed `batches` that it does not cover."""
        ledger = self.spark.read.schema(DELTA).option("recursiveFileLookup", "true").parquet(f"{self.folder}/deltas")
        if covered:
            batches = batches.join(self.spark.read.schema(COMMIT).parquet(f"{self.folder}/snapshots/{covered}/covers"), "batch", "left_anti")
        counted = ledger.join(batches, "batch", "left_semi").select(*KEY, "documents", "tokens")
        if covered:
            counted = counted.unionByName(self.spark.read.schema(TOTAL).parquet(f"{self.folder}/snapshots/{covered}/totals"))
        summed = counted.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter((F.col("documents") != 0) | (F.col("tokens") != 0))

    def write_snapshot(self) -> int:
        """Write the next snapshot; it counts once `compact` has listed it as whole, so one cut short is written over."""
        last = self._snapshot()
        place = f"{self.folder}/snapshots/{last + 1}"
        self.committed().distinct().write.mode("overwrite").parquet(f"{place}/covers")
        covers = self.spark.read.schema(COMMIT).parquet(f"{place}/covers")
        self._summed(last, covers).write.mode("overwrite").parquet(f"{place}/totals")
        return last + 1

    def compact(self) -> None:
        """Sum all batches committed so far, so that totals no longer read them."""
        number = self.write_snapshot()
        self.spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("append").parquet(f"{self.folder}/whole")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents and tokens over all committed batches."""
        return self._summed(self._snapshot(), self.committed().distinct())


def estimated(docs: DataFrame) -> DataFrame:
    """The counts that documents come with, before any tokenizer has run: a token for each four code points."""
    guess = docs.select("source", "lang", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("tokens"))
    versions = F.explode(F.array(*[F.lit(v) for v in VERSIONS.values()])).alias("tokenizer")
    return guess.select("source", "lang", versions, "tokens")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version.

    All documents come with estimated counts, which a second batch revises to those of
    the tokenizers. Then those without a language or in German go, and come again.
    The second batch is committed twice. The totals are those of all documents.
    Reads source, lang and text of the whole table; the module's defined cases hold.
    """
    docs = common.documents(spark, sf_dir)
    counts = common.store(token_counts(docs), "rollup-count")
    guesses = estimated(docs)
    rollup = Rollup(spark, f"{common.shared_folder(spark)}/lotwright/rollup-{uuid.uuid4().hex}")
    some = counts.filter(F.coalesce(F.col("lang") == "de", F.lit(True)))
    batches = {"arrival": inserts(guesses), "recount": revisions(guesses, counts), "withdrawal": deletes(some), "return": inserts(some)}
    for batch in (*batches, "recount"):
        rollup.commit(batch, batches[batch])
    return rollup.totals()
