"""Resolving positions to producers through a registry and through each other.

A value is passed on only where its donors agree: they must name one company, or
nothing is filled and the conflict is counted. Donors are aggregated by key before
they meet the recipients, so a key with very many rows is one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import normalise as N


def unanimous(donors: DataFrame, keys: list[str], value: str, core: Column, position: str) -> DataFrame:
    """The first donor's value of each key, and the number of different companies among its donors."""
    return donors.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, position).alias("donated"), F.count_distinct(core).alias("companies")
    )


def fill(rows: DataFrame, donated: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill missing values from unanimous donors; `source` tells where a value is from, `conflict` that donors disagreed."""
    joined = rows.join(donated, keys, "left")
    missing, one = F.col(value).isNull(), F.col("companies") == 1
    return joined.select(
        *rows.columns,
        F.when(missing & one, F.col("donated")).otherwise(F.col(value)).alias("filled"),
        F.when(~missing, "own").when(one, "donor").otherwise("none").alias("source"),
        (missing & F.coalesce(F.col("companies") > 1, F.lit(False))).alias("conflict"),
    )


def registry_cascade(queries: DataFrame, registry: DataFrame, steps: list[tuple[str, str]], producer: str, producer_core: Column, one_firm=None) -> DataFrame:
    """Look keys up in order: the first step whose hits name one producer answers; others fall through.

    `steps` are pairs of a column of `queries` and the column of `registry` that it must
    equal. Producers are one by equal cores, or as `one_firm` (such as `firms.unanimous`) has it.
    """
    out, taken = queries, F.lit(None).cast("string")
    step_name = F.lit(None).cast("string")
    for i, (asked, held) in enumerate(steps):
        known = registry.filter(F.col(held).isNotNull())
        if one_firm is None:
            hits = known.groupBy(F.col(held).alias(f"_k{i}")).agg(F.min(producer).alias(f"_p{i}"), F.count_distinct(producer_core).alias(f"_n{i}"))
        else:
            found = one_firm(known, [held], producer, producer)
            hits = found.select(F.col(held).alias(f"_k{i}"), F.col("donated").alias(f"_p{i}"), F.col("companies").alias(f"_n{i}"))
        out = out.join(hits, F.col(asked) == F.col(f"_k{i}"), "left")
        answer = F.col(f"_n{i}") == 1
        step_name = F.coalesce(step_name, F.when(answer, F.lit(asked)))
        taken = F.coalesce(taken, F.when(answer, F.col(f"_p{i}")))
    return out.select(*queries.columns, taken.alias("producer"), step_name.alias("found_by"))


def extend_marks(rows: DataFrame, number: str, mark: str) -> DataFrame:
    """Within a number, a mark that exactly one longer mark extends becomes that one.

    An extension goes on with a character that is no letter.
    """
    marks = rows.select(number, mark).filter(F.col(mark).isNotNull()).distinct()
    longer = marks.select(F.col(number).alias("_n"), F.col(mark).alias("_long"))
    rest = F.substring(F.col("_long"), F.length(mark) + 1, F.lit(1))
    pairs = marks.join(longer, (F.col(number) == F.col("_n")) & F.startswith("_long", F.col(mark)) & (F.col("_long") != F.col(mark)) & ~rest.rlike("[A-Za-zА-Яа-яЁё]"))
    only = pairs.groupBy(F.col(number).alias("_n"), F.col(mark).alias("_m")).agg(F.count("*").alias("_c"), F.min("_long").alias("_long"))
    joined = rows.join(only, (F.col(number) == F.col("_n")) & (F.col(mark) == F.col("_m")), "left")
    return joined.select(*rows.columns, F.when(F.col("_c") == 1, F.col("_long")).otherwise(F.col(mark)).alias("extended"))


def document_frequency(docs: DataFrame, key: str, tokens: Column, among: DataFrame | None = None) -> DataFrame:
    """In how many documents each token is, and the share of all; of the tokens `among` (token) only, where given."""
    pairs = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    pairs = pairs if among is None else pairs.join(among, "token", "left_semi")
    total = docs.agg(F.count("*").alias("_all"))
    return pairs.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select(  # one row
        "token", "df", F.round(F.col("df") / F.col("_all"), 6).alias("share")
    )


def token_weight(token: Column) -> Column:
    """Telling power: designations with digits above words, long above short."""
    return F.when(token.rlike(r"\d"), F.when(F.length(token) >= 4, 4.0).otherwise(2.5)).otherwise(F.when(F.length(token) >= 5, 3.0).otherwise(2.0))


def apply_registry(rows: DataFrame, number: str, registry: DataFrame, held: str) -> DataFrame:
    """Fill positions from the registry record of their number.

    `rows` have name, manufacturer and mark, `registry` producer, declarant, status,
    r_name and unified (the number in the common form). What the contract says of the
    maker stays; what fills a gap is from the registry, with high confidence where the
    names agree or share a designation. A mark is cleared where the record contradicts it.
    """
    joined = rows.join(registry, F.col(number) == F.col(held), "left")
    known, gap = F.col(held).isNotNull(), F.col("manufacturer").isNull()
    agrees = (N.name_key(F.col("name")) == N.name_key(F.col("r_name"))) | E.shares_mark(F.col("name"), F.col("r_name"))
    confidence = F.when(~gap, "high").when(F.col("producer").isNull(), "").when(agrees, "high").otherwise("medium")
    source = F.when(~gap, "contract").when(F.col("producer").isNotNull(), "registry").otherwise("none")
    refuted = known & E.contradicts(F.col("mark"), F.col("r_name"))
    columns = [c for c in rows.columns if c not in ("manufacturer", "mark")]
    return joined.select(
        *columns, F.coalesce("manufacturer", "producer").alias("manufacturer"), source.alias("source"), confidence.alias("confidence"),
        F.when(known, F.col("declarant")).alias("holder"), F.col("status"), F.coalesce(F.col("unified"), F.col(number).cast("string")).alias("unified"),
        F.when(~refuted, F.col("mark")).alias("mark"),
    )


def holder_with_number(manufacturer: Column, holder: Column, number: Column) -> Column:
    """The holder of a registration, which a position without a number has none of; its maker stays."""
    return F.when(N.blank_to_null(number.cast("string")).isNotNull() | manufacturer.isNull(), holder)


def match_rules(questions: DataFrame, records: DataFrame, frequency: DataFrame, *, least: float = 3.0, most_share: float = 0.3, tie: float = 0.01, plain: Column | None = None) -> DataFrame:
    """Score records by the weights of the telling tokens that they share with a question.

    `questions` (q, token), `records` (r, firm, token), `frequency` (token, share). A
    question is answered if its best score reaches `least` and all records as good are
    of one firm, however its name is quoted or its form written; of those the smallest is named. `plain` is the token without a prefix
    that keeps kinds apart.
    """
    telling = frequency.filter(F.col("share") <= most_share).select("token")
    shared = questions.join(telling, "token").join(records, "token")
    scores = shared.groupBy("q", "r", "firm").agg(F.round(F.sum(token_weight(F.col("token") if plain is None else plain)), 4).alias("score"))
    best = scores.withColumn("top", F.max("score").over(Window.partitionBy("q"))).filter((F.col("score") >= F.col("top") - tie) & (F.col("top") >= least))
    return best.groupBy("q").agg(F.min("r").alias("r"), F.max("top").alias("score"), F.count_distinct(N.producer_key(F.col("firm"))).alias("firms"), F.min("firm").alias("firm")).filter("firms = 1").drop("firms")


def bridge(observed: DataFrame, kind: str, code: str, contract: str) -> DataFrame:
    """Codes seen with a kind: in how many contracts, and whether a code has that kind alone."""
    seen = observed.groupBy(kind, code).agg(F.count_distinct(contract).alias("contracts"))
    kinds = observed.groupBy(F.col(code).alias("_c")).agg(F.count_distinct(kind).alias("kinds"))
    return seen.join(kinds, F.col(code) == F.col("_c")).select(kind, code, "contracts", (F.col("kinds") == 1).alias("only_kind"))


def two_hop(edges: DataFrame, seeds: DataFrame, node: str, via: str) -> DataFrame:
    """Nodes that share a `via` value with a seed node, seeds included; each once."""
    first = edges.join(seeds, node, "left_semi").select(via).distinct()
    return edges.join(first, via, "left_semi").select(node).union(edges.join(seeds, node, "left_semi").select(node)).distinct()
