"""Selecting contracts and positions: scans, unions of queries, verdicts, services."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import identifiers as I
from ..functions import normalise as N
from ..sources.stored import store
from .ranking import first_wins


def scan_by_code(positions: DataFrame, codes: list[str], date: str, first: str, last: str, stage: str, stages: list[str]) -> DataFrame:
    """Positions of codes, in a period and in stages; a plain filter, so that it reaches the files."""
    return positions.filter(F.col("ktru").isin(*codes) & F.col(date).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")) & F.col(stage).isin(*stages))


def has_words(text: Column, words: list[str]) -> Column:
    """Whether a text holds all words, in any case."""
    low = F.lower(text)
    found = F.lit(True)
    for w in words:
        found &= low.contains(w.lower())
    return found


def union_first(queries: list[DataFrame], key: str, position: str) -> DataFrame:
    """Results of several queries, each key once, from the first query that found it."""
    numbered = [q.withColumn("query_no", F.lit(i)) for i, q in enumerate(queries)]
    every = numbered[0]
    for q in numbered[1:]:
        every = every.unionByName(q)
    return first_wins(every, [key], [F.col("query_no"), F.col(position)])


def collect_rows(positions: DataFrame, codes: list[str], contract: str) -> DataFrame:
    """Positions with a wanted code, and those without a code that share a name with one in the same contract."""
    keyed = positions.withColumn("_name", N.name_key(F.col("name")))
    coded = keyed.filter(F.col("ktru").isin(*codes))
    names = coded.select(contract, "_name").distinct()
    rescued = keyed.filter(F.col("ktru").isNull()).join(names, [contract, "_name"], "left_semi")
    columns = positions.columns
    return coded.select(*columns, F.lit("code").alias("by")).unionByName(rescued.select(*columns, F.lit("name").alias("by")))


CHOSEN = ("name", "ktru_name", "trademark", "mark", "specs_text")
FAMILY = ("ru_name", "ru_variants")


def collected(positions: DataFrame, *, codes: list[str] = (), registrations: list[str] = (), phrases: list[str] = (), drop_services: bool = False) -> tuple[DataFrame, DataFrame]:
    """The positions that a search is for, and one row with what was left out and why.

    Conditions of different sorts must all hold; of several codes, registrations or
    phrases one is enough. With codes, a position without one is taken where it has the
    name of a wanted one of its contract. `positions` have contract, ktru, ru_number and
    the columns CHOSEN and FAMILY; `by`, `note` and `doubt` are added, and a number that a
    text gives is filled in.
    """
    registrations, phrases = ([v for v in values if v.strip()] for values in (registrations, phrases))
    key = N.name_key(F.coalesce("name", F.lit("")))
    if codes:
        coded = F.coalesce(F.col("ktru").isin(*codes), F.lit(False))
        marked = positions.withColumn("_coded", coded).withColumn("_key", key)
        both = F.array(F.col("_key"), N.name_key(F.coalesce("ktru_name", F.lit(""))))
        names = marked.filter("_coded").select(F.col("contract").alias("_c"), F.explode(both).alias("_n")).filter("_n <> ''").distinct().withColumn("_named", F.lit(True))
        marked = marked.join(names, (F.col("contract") == F.col("_c")) & (F.col("_key") == F.col("_n")), "left").drop("_c", "_n")
        by = F.when(F.col("_coded"), "code").when(N.blank_to_null(F.col("ktru")).isNull() & F.col("_named"), "name")
    else:
        marked = positions.withColumns({"_coded": F.lit(False), "_key": key, "_named": F.lit(None).cast("boolean")})
        by = F.lit("all")
    marked = marked.withColumn("by", by)
    # verdicts are dear, so only what codes or names have taken is judged
    said, taken = F.concat_ws(" ", *CHOSEN, "ru_name"), marked.filter("by is not null")
    fits, note, doubt = F.lit(True), F.lit(""), F.lit("")
    if registrations:
        fits &= E.any_match(F.array(*map(F.lit, registrations)), said)
    taken = taken.withColumn("_fits", fits)
    if phrases:
        verdict = F.when(F.col("_fits"), judge_any(phrases, F.concat_ws(" ", *CHOSEN), F.concat_ws(" ", *FAMILY), F.lit("")))
        taken = taken.withColumn("_v", verdict)
        fits, note, doubt = F.col("_fits") & F.coalesce(F.col("_v.ok"), F.lit(False)), F.coalesce("_v.note", F.lit("")), F.coalesce("_v.doubt", F.lit(""))
    taken = taken.withColumns({"_fits": fits, "note": note, "doubt": doubt, "_service": F.coalesce(I.is_service(F.col("name")), F.lit(False))})
    taken = store(taken, "collected")
    kept = F.col("_fits") & ~F.col("_service") if drop_services else F.col("_fits")
    n = lambda c: F.count(F.when(c, 1))
    some = F.lit(bool(codes))
    before = marked.agg(
        n(some & ~F.col("_coded")).alias("filtered"), n(some & N.blank_to_null(F.col("ktru")).isNull()).alias("without_code"),
        F.when(some, F.count_distinct("contract") - F.count_distinct(F.when(F.col("_coded"), F.col("contract")))).otherwise(F.lit(0)).alias("contracts_without"),
    )
    after = taken.agg(
        n(F.col("by") == "name").alias("by_name"), n(~F.col("_fits")).alias("off_query"), n(F.col("_fits") & F.col("_service") & F.lit(drop_services)).alias("services"),
        n(kept & (F.col("doubt") == VARIANT)).alias("listed_only"), n(kept & (F.col("doubt") == BRAND)).alias("brand_unnamed"), n(kept).alias("rows"),
    )
    number = F.coalesce(N.blank_to_null(F.col("ru_number").cast("string")), I.main_registration(F.coalesce("ru_name", "name"), F.coalesce("ktru_name", "name")))
    columns = [c for c in positions.columns if c != "ru_number"]
    rows = taken.filter(kept).select(*columns, number.alias("ru_number"), "by", "note", "doubt")
    return rows, before.crossJoin(F.broadcast(after))  # one row each


def without_services(positions: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The positions that are goods (all, with `keep`), and one row with the number of those dropped."""
    service = I.is_service(F.col(name))
    dropped = positions.agg(F.count(F.when(service, 1)).alias("services"))
    return (positions if keep else positions.filter(~service)), (dropped.select((F.col("services") * 0).alias("services")) if keep else dropped)


def kind_slice(registry: DataFrame, kind: Column, order: list[str], most: int = 1200) -> DataFrame:
    """The first `most` records of a kind, with what tells a caller that this is not all of it.

    `total` is the number of records of the kind, `truncated` whether there are more than
    `most`, and `unfiltered` whether all records of the registry are of it, as where the
    source did not heed the filter.
    """
    counts = registry.agg(F.count(F.when(kind, 1)).alias("total"), F.count("*").alias("_all"))
    head = registry.filter(kind).orderBy(*order).limit(most)
    marked = head.crossJoin(F.broadcast(counts))  # one row
    return marked.select(*registry.columns, "total", (F.col("total") > most).alias("truncated"), (F.col("total") == F.col("_all")).alias("unfiltered"))


def pick_attachment(files: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, name, rank): each owner's file that stands best for the contract, the smallest name of equals; none where no file does."""
    ranked = files.withColumn("rank", I.attachment_rank(I.clean_file_name(F.col(name)))).filter("rank >= 0")
    best = F.min_by(F.struct(F.col(name), F.col("rank")), F.struct(-F.col("rank"), F.col(name))).alias("_best")
    return ranked.groupBy(owner).agg(best).select(owner, f"_best.{name}", "_best.rank")


# --- verdicts ---

LISTED = "модель только в перечне исполнений РУ"
UNNAMED = "бренд в контракте не назван"
KNOWN = "бренд не назван в контракте, но так зовут производителя"


def _family(key: Column) -> Column:
    return F.regexp_extract(key, r"^([a-z]*)\d", 1)


def judge(phrase: Column, chosen: Column, family: Column, known: Column) -> Column:
    """How well a position meets a search phrase, as a struct: ok, note, doubt, rank.

    Every article of the phrase must be in the chosen text, or else in the text of the
    registration, unless the chosen text names another model of the article's family;
    names must sound in either text, or else a telling article stands for them.
    """
    articles, names = I.phrase_articles(phrase), I.phrase_names(phrase)
    in_chosen, in_family = I.article_keys(chosen), I.article_keys(family)
    sounds = F.concat_ws(" ", N.phonetic_words(chosen), N.phonetic_words(family))
    has = lambda keys, a: F.exists(keys, lambda k: F.contains(k, a))
    sibling = lambda a: (F.length(_family(a)) >= 2) & F.exists(in_chosen, lambda k: (k != a) & (_family(k) == _family(a)))
    several = lambda a: (_family(a) != "") & (F.size(F.filter(in_family, lambda k: _family(k) == _family(a))) > 1)
    # of each article: s(ure), l(isted among others), f(amily's only one), n(ot there)
    state = F.transform(
        articles,
        lambda a: F.when(has(in_chosen, a), "s").when(sibling(a), "n").when(has(in_family, a), F.when(several(a), "l").otherwise("f")).otherwise("n"),
    )
    listed = F.array_contains(state, "l")
    named = F.forall(names, lambda n: (n != "") & F.contains(sounds, n))
    telling = F.exists(articles, lambda a: a.rlike(r"^[a-z]{2,}\d"))
    known_sounds = N.phonetic_words(known)
    by_registry = (F.coalesce(known, F.lit("")) != "") & F.forall(names, lambda n: (n != "") & F.contains(known_sounds, n))
    some = (F.size(articles) > 0) | (F.size(names) > 0)
    ok = some & ~F.array_contains(state, "n") & (named | telling)
    raw = F.trim(F.regexp_replace(phrase, r"\s+", " "))
    why = F.concat_ws(", ", F.when(listed, LISTED), F.when(~named & ~by_registry, UNNAMED), F.when(~named & by_registry, KNOWN))
    note = F.when(why != "", F.concat(raw, F.lit(": "), why)).otherwise(raw)
    doubt = F.when(listed, "исполнение").when(~named & ~by_registry, "бренд").otherwise("")
    return F.when(ok, F.struct(F.lit(True).alias("ok"), note.alias("note"), doubt.alias("doubt"), F.when(doubt == "", 0).otherwise(1).alias("rank"))).otherwise(
        F.struct(F.lit(False).alias("ok"), F.lit("").alias("note"), F.lit("").alias("doubt"), F.lit(3).alias("rank"))
    )


def judge_any(phrases: list[str], chosen: Column, family: Column, known: Column) -> Column:
    """The best verdict over several phrases, the first of equals."""
    verdicts = [judge(F.lit(p), chosen, family, known) for p in phrases if p.strip()]
    ranked = F.array(*[F.struct(v["rank"].alias("r"), F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(verdicts)])
    return F.array_min(F.transform(ranked, lambda x: F.struct(x["r"].alias("r"), x["i"].alias("i"), x["v"].alias("v"))))["v"]


BRAND, VARIANT = "бренд", "исполнение"


def confirm_brand(rows: DataFrame, doubt: str, phrase: Column, record: Column) -> DataFrame:
    """Clear doubts about the brand where the registry record's own text has all names of the phrase, by sound; `confirmed` marks them."""
    names = I.phrase_names(phrase)
    sounds = N.phonetic_words(record)
    named = (F.size(names) > 0) & F.forall(names, lambda n: (n != "") & F.contains(sounds, n))
    yes = (F.col(doubt) == BRAND) & F.coalesce(named, F.lit(False))
    return rows.withColumn("confirmed", yes).withColumn(doubt, F.when(yes, "").otherwise(F.col(doubt)))


def resolve_variant(rows: DataFrame, doubt: str, asked: Column, variant: Column, quote: Column, text: Column) -> DataFrame:
    """Settle doubts about the variant by answers that their own quotations support.

    A supported answer that is the article asked for clears the doubt, another one drops
    the row; without a supported answer the doubt stays.
    """
    supported = (F.col(doubt) == VARIANT) & E.variant_supported(variant, quote, text)
    right = supported & (N.latin_key(variant) == N.latin_key(asked))
    marked = rows.withColumn("_right", right).withColumn("_wrong", supported & ~right)
    return marked.filter(~F.col("_wrong")).withColumn(doubt, F.when(F.col("_right"), "").otherwise(F.col(doubt))).drop("_right", "_wrong")


# --- planning of searches ---


@dataclass
class Search:
    """What a user asks for."""

    codes: list[str] = field(default_factory=list)
    registrations: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    only_codes: bool = False


def plan(search: Search, spellings=None, words=None) -> list[tuple[str, str]]:
    """The (kind, value) scans of a search in order, each once whatever its case."""
    asked = [("code", c) for c in search.codes]
    if not (search.codes and search.only_codes):
        asked += [("registration", r) for r in search.registrations]
        for phrase in search.phrases:
            for spelling in (spellings or (lambda p: [p]))(phrase):
                asked += [("word", w) for w in (words or str.split)(spelling)]
    seen: dict = {}
    for kind, value in asked:
        seen.setdefault((kind, value.lower()), (kind, value))
    return list(seen.values())
