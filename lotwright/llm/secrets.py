"""Secret scans with multipart credential linking.

Three kinds of strong spans stand by themselves: assignments of a secret, access
identifiers and long hexadecimal runs. Weak candidates look like parts of a
credential but occur in ordinary text too: identifiers in capitals and digits, mixed
tokens, and endpoints. They are reported only in company. Parts of a document are
interval-joined: each part's scope is its span and SCOPE code points on either side,
and parts of different sorts (identifier, secret, endpoint) are complementary and link
when one lies in the scope of the other. An endpoint is weak, however it is written.

* A link of a weak part with a strong one reports the weak part, so an endpoint beside
  a strong identifier or secret is reported too.
* A link of a weak identifier and a weak secret reports both, if an endpoint lies in
  the scope of either, and the endpoint with them; a weak part and an endpoint alone
  are ordinary text.

The join is an equi-join on the document and a bucket of positions as long as a
scope; a part is in every bucket that its span meets, with its scope on one side, so
that parts meet however long they are.

Defined cases: a null text is empty and has no spans; a very long text is scanned
whole, and a span of any length is one part; spans of equal start are in order of
kind, then of end; repeated rows and ids are scanned each, parts being joined by row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCOPE = 200
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
STRONG = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]{4,}|(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![\w.])""")
#: A weak secret's own variety: it has all three classes.
CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strong spans, kind by kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # a run of 16 or more is the whole run, as a match begins where the run does
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no strong span."""
    out = [("weak_access", m.start(), m.end()) for m in WEAK_ACCESS.finditer(text)]
    out += [("weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if all(c.search(m[0]) for c in CLASSES)]
    if out or strong:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    # the furthest end of the strong spans that start before each, so that long lists need no pairs
    ranked = sorted((s, e) for _, s, e in strong)
    starts, ends = [s for s, _ in ranked], list(accumulate((e for _, e in ranked), max))
    return [x for x in out if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[1]]


def ordered(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<kind:string,s:int,e:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Strong spans of every document, and all its parts where it has weak ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                strong = base_spans(text)
                weak = weak_spans(text, strong)
                kinds = [k for k, _, _ in strong]
                base = ordered(strong)
                parts = [{"kind": k, "s": s, "e": e} for k, s, e in strong + weak] if weak else []
                out.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), base, parts))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, FOUND)


def _bucketed(parts: DataFrame, prefix: str, scope: int) -> DataFrame:
    """Parts with all buckets that their span, `scope` wider on either side, meets."""
    bucket = F.explode(F.sequence(F.floor((F.col("s") - scope) / SCOPE), F.floor((F.col("e") + scope) / SCOPE)))
    return parts.withColumn("bucket", bucket).select("row", "bucket", *[F.col(c).alias(f"{prefix}_{c}") for c in ("kind", "s", "e", "weak")])


def _close(a: str, b: str):
    """Whether one span lies in the scope of the other."""
    return (F.col(f"{a}_s") <= F.col(f"{b}_e") + SCOPE) & (F.col(f"{b}_s") <= F.col(f"{a}_e") + SCOPE)


def linked(parts: DataFrame) -> DataFrame:
    """(row, kind, s, e) of the weak parts that complementary parts confirm."""
    parts = parts.withColumn("weak", F.col("kind").startswith("weak"))
    ids = parts.filter(F.col("kind").isin("access", "weak_access"))
    secret = parts.filter(F.col("kind").isin("assign", "hex", "weak_secret"))
    ends = parts.filter(F.col("kind") == "endpoint")
    pairs = _bucketed(ids, "i", SCOPE).join(_bucketed(secret, "k", 0), ["row", "bucket"]).filter(_close("i", "k") & (F.col("i_weak") | F.col("k_weak")))
    pairs = pairs.drop("bucket").distinct()
    one = pairs.filter(F.col("i_weak") != F.col("k_weak")).select(
        "row", F.when(F.col("i_weak"), F.struct(F.col("i_kind").alias("kind"), F.col("i_s").alias("s"), F.col("i_e").alias("e")))
        .otherwise(F.struct(F.col("k_kind").alias("kind"), F.col("k_s").alias("s"), F.col("k_e").alias("e"))).alias("part"),
    )
    two = pairs.filter(F.col("i_weak") & F.col("k_weak")).withColumn("s", F.least("i_s", "k_s")).withColumn("e", F.greatest("i_e", "k_e"))
    reach = two.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("s") - SCOPE) / SCOPE), F.floor((F.col("e") + SCOPE) / SCOPE))))
    met = reach.join(_bucketed(ends, "n", 0), ["row", "bucket"]).filter(_close("i", "n") | _close("k", "n"))
    three = met.select("row", F.explode(F.array(*[F.struct(F.col(f"{p}_kind").alias("kind"), F.col(f"{p}_s").alias("s"), F.col(f"{p}_e").alias("e")) for p in "ikn"])).alias("part"))
    beside = _bucketed(ends, "n", SCOPE).join(_bucketed(parts.filter(F.col("kind").isin(*STRONG)), "k", 0), ["row", "bucket"]).filter(_close("n", "k"))
    lone = beside.select("row", F.struct(F.col("n_kind").alias("kind"), F.col("n_s").alias("s"), F.col("n_e").alias("e")).alias("part"))
    return one.unionByName(three).unionByName(lone).distinct().select("row", "part.*")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of strong spans, and all spans of every document."""
    found = common.store(scan(docs).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    parts = found.filter(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    more = linked(parts).groupBy("row").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
    joined = found.join(more, "row", "left")
    spans = F.filter("parts", lambda p: p["kind"].isin(*STRONG))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(F.concat(spans, F.col("more")), lambda p: F.struct(p["s"].alias("s"), rank[p["kind"]].alias("rank"), p["e"].alias("e"), p["kind"].alias("kind"))))
    text = F.array_join(F.transform(keyed, lambda p: F.concat_ws(":", p["kind"], p["s"], p["e"])), ",")
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents.

    Reads doc_id and text of the whole table; the module's defined cases hold.
    """
    return scanned(common.documents(spark, sf_dir))
