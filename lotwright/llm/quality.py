"""Quality classifier: boosted trees over document statistics.

Statistics of whole texts are computed where the texts are, batch by batch. The
model is fitted on a bounded sample of labelled rows and scores every document by
walking its flattened trees in numpy.

Defined cases: a null text is an empty one and gets a score; with no usable label
every score is a constant; a document with several labels counts with the smallest;
rows with the same statistics tie and get equal scores; a very long text is measured
whole; an empty table gives an empty result; other columns are ignored, even one
named score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common

#: The model is fitted on at most so many labelled rows, those of the smallest hash.
TRAINING_ROWS = 20_000
ACCEPTED = 0.3

_CLASS = np.full(256, 7)  # 7: other ASCII symbols
_CLASS[[32, 9, 11, 12, 13]] = 0  # space
_CLASS[10] = 1  # line end
_CLASS[97:123] = 2  # lower-case letters
_CLASS[65:91] = 3  # capitals
_CLASS[48:58] = 4  # digits
_CLASS[128:] = 5  # beyond ASCII
_CLASS[[44, 46]] = 6  # comma, full stop

STATISTICS = (
    "space", "line_end", "lower", "capital", "digit", "beyond", "stop", "symbol",
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "one_mark_words", "symbol_words",
    "lines", "distinct_lines", "top_byte", "byte_entropy", "compressed",
)


def statistics(text: str) -> np.ndarray:
    """The numbers that describe a text, in order of STATISTICS."""
    raw = text.encode()
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, counts, 8) / n
    words = raw.split()
    many = max(len(words), 1)
    seen = Counter(words)
    lines = raw.split(b"\n")
    p = counts[counts > 0] / n
    last = Counter(w[-1] for w in words)
    ends = sum(v for k, v in last.items() if _CLASS[k] == 7)
    return np.array([
        *shares, np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / many, len(seen) / many,
        max(seen.values(), default=0) / many, sum(v for k, v in seen.items() if len(k) == 1) / many, ends / many,
        len(lines) / many, len(set(lines)) / len(lines), counts.max() / n, -(p * np.log2(p)).sum(),
        len(zlib.compress(raw, 1)) / n,
    ])


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.vstack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(STATISTICS)))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """text and y of the sample of labelled rows, none of them held out; of texts of one id, the greatest."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~common.held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min(target).alias("y"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> boosting.Forest:
    """The model; only numbers of at most `rows` documents come to the driver."""
    names = [f"f{i}" for i in range(len(STATISTICS))]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_matrix(batch["text"]), columns=names).assign(y=batch["y"].to_numpy())

    sample = training_rows(docs, labels, "quality", rows)
    got = sample.mapInPandas(measure, ", ".join(f"{c} double" for c in names) + ", y int").toPandas().sort_values([*names, "y"])
    return boosting.fit(got[names].to_numpy(float), got["y"].to_numpy(float))


def scored(docs: DataFrame, model: boosting.Forest, name: str = "score") -> DataFrame:
    """`docs` with a column for the score, whose name the caller gives if `docs` may have one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_matrix(texts)))

    return docs.withColumn(name, score(F.coalesce("text", F.lit(""))))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with its columns."""
    name = common.fresh(docs, "score")
    return scored(docs, fit(docs, labels), name).filter(F.col(name) >= ACCEPTED).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document.

    Reads doc_id and text of the whole table, and the labels that are not held out;
    the module's defined cases hold.
    """
    docs = common.documents(spark, sf_dir)
    out = scored(docs.select("doc_id", "text"), fit(docs, common.labels(spark, sf_dir)))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
