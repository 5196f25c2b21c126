"""Looking records up by pieces of their names.

A source that finds texts containing a phrase is an index of grams: a phrase meets
only the texts that have its rarest gram, and is then compared whole. Catalogue cards
are met by the first letters of their words. Answers of too many records are none:
they are counted and flagged, and so are answers cut to the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import identifiers as I
from ..functions import normalise as N
from ..sources.stored import store

GRAM = 3
TOO_BROAD = 400
MOST_CARDS = 40
LEAST_MATCH = 0.5
LEAST_FIRM = 4


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` letters."""
    last = F.length(text) - (size - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, r) for every text that contains a question's phrase, case and ё aside; blank phrases are in none.

    `questions` have q and phrase, `texts` r and text, each r once.
    """
    asked = questions.select("q", N.folded(F.trim(F.coalesce("phrase", F.lit("")))).alias("p")).filter("p <> ''").distinct()
    phrases = asked.select("p").distinct()
    own = F.when(F.length("p") >= GRAM, _grams(F.col("p"), GRAM)).otherwise(F.array("p"))  # a short phrase is its own gram
    wanted = phrases.select("p", F.explode(own).alias("gram"))
    held = texts.select("r", N.folded(F.coalesce("text", F.lit(""))).alias("t"))
    every = held.select("r", F.explode(F.flatten(F.array(*[_grams(F.col("t"), n) for n in range(1, GRAM + 1)]))).alias("gram"))
    postings = every.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("p").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(postings, "gram").join(held, "r").filter(F.contains("t", F.col("p"))).select("p", "r")
    return asked.join(met, "p").select("q", "r")


def by_name(questions: DataFrame, records: DataFrame, text: str, too_broad: int = TOO_BROAD) -> DataFrame:
    """(q, total, too_broad, records): how many records' texts contain a phrase, and which, unless they are too many.

    Each different text is looked at once, and counts for all its records; records are
    read only for the questions that are answered.
    """
    said = records.select("r", F.coalesce(text, F.lit("")).alias("said"))
    once = store(said.groupBy("said").agg(F.count("*").alias("n")), "lookup-texts")
    hits = store(containing(questions, once.select(F.col("said").alias("r"), F.col("said").alias("text"))).withColumnRenamed("r", "said"), "lookup-hits")
    total = hits.join(once, "said").groupBy("q").agg(F.sum("n").alias("total"))
    told = questions.select("q").distinct().join(total, "q", "left").select("q", F.coalesce("total", F.lit(0)).alias("total"))
    told = store(told.withColumn("too_broad", F.col("total") > too_broad), "lookup-totals")
    answered = hits.join(told.filter("not too_broad"), "q", "left_semi")
    kept = answered.join(said, "said").groupBy("q").agg(F.array_sort(F.collect_list("r")).alias("records"))
    return told.join(kept, "q", "left")


def by_firm(questions: DataFrame, records: DataFrame, too_broad: int = TOO_BROAD) -> DataFrame:
    """(q, field, total, too_broad, records): records of a firm by a piece of its name, of four letters at least.

    The producers are asked first, and the declarants only by those whom no producer answers.
    """
    asked = questions.select("q", F.trim(F.coalesce("phrase", F.lit(""))).alias("phrase"))
    long_enough = asked.filter(F.length("phrase") >= LEAST_FIRM)
    first = store(by_name(long_enough, records, "producer", too_broad), "lookup-producer")
    rest = store(long_enough.join(first.filter("total = 0"), "q", "left_semi"), "lookup-rest")
    second = by_name(rest, records, "declarant", too_broad).withColumn("field", F.lit("declarant"))
    both = first.filter("total > 0").withColumn("field", F.lit("producer")).unionByName(second)
    return asked.select("q").distinct().join(both, "q", "left").select("q", "field", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("too_broad", F.lit(False)).alias("too_broad"), "records")


def firm_records(questions: DataFrame, records: DataFrame, too_broad: int = TOO_BROAD) -> DataFrame:
    """(q, r) of the records of the firm that a trade mark names, in either alphabet.

    The firms that the mark itself finds are read for Cyrillic words that sound just like
    it; each such word is asked for in its turn.
    """
    first = store(by_firm(questions, records, too_broad).select("q", F.explode("records").alias("r")), "lookup-first")
    sound = questions.select(F.col("q").alias("q_"), N.phonetic(F.coalesce("phrase", F.lit(""))).alias("sound")).filter(F.length("sound") >= LEAST_FIRM)
    names = first.join(records.select("r", F.concat_ws(" ", "producer", "declarant").alias("names")), "r").select("q", "names").distinct()
    words = names.select("q", F.explode(F.transform(I.every(F.col("names"), "[А-Яа-яЁё]{5,}"), F.lower)).alias("word")).distinct()
    alike = words.join(sound, (F.col("q") == F.col("q_")) & (N.phonetic(F.col("word")) == F.col("sound")))
    again = store(alike.select(F.struct("q", "word").alias("q"), F.col("word").alias("phrase")).distinct(), "lookup-again")
    second = by_firm(again, records, too_broad).select("q.q", F.explode("records").alias("r"))
    return first.union(second).distinct()


def confirmed_number(questions: DataFrame, records: DataFrame) -> DataFrame:
    """(q, r): the first record of exactly the number asked for, if its records name one producer at most."""
    key = lambda c: N.number_key(F.coalesce(F.col(c).cast("string"), F.lit("")))
    asked = questions.select("q", key("number").alias("k")).filter("k <> ''")
    firm = N.producer_key(F.coalesce("producer", F.lit("")))
    known = records.select("r", key("number").alias("k"), F.when(firm != "", firm).alias("firm")).join(asked.select("k").distinct(), "k", "left_semi")
    held = known.groupBy("k").agg(F.min("r").alias("r"), F.count_distinct("firm").alias("firms")).filter("firms <= 1")
    return asked.join(held, "k").select("q", "r")


def _letters(c: Column) -> Column:
    return F.regexp_replace(N.folded(F.coalesce(c, F.lit(""))), "[^a-zа-я0-9]+", "")


def by_card_name(questions: DataFrame, cards: DataFrame, most: int = MOST_CARDS, least: float = LEAST_MATCH) -> DataFrame:
    """(q, place, code, name, match, exact, found, cut): the best catalogue cards for a kind's name.

    `questions` have q and name, `cards` code and name, of a code the first name. A card of
    the very name comes first, then by how much the names match; `found` tells how many do,
    `cut` that only the `most` best are listed. A match needs the kind's first word, so a
    card is met by the first five letters of its words.
    """
    once = cards.filter(N.blank_to_null(F.col("code")).isNotNull()).groupBy("code").agg(F.min("name").alias("card"))
    kinds = questions.select("q", F.col("name").alias("kind"))
    start = lambda w: F.left(w, F.lit(5))
    first = kinds.select("kind", start(F.get(E.kind_words(F.col("kind")), F.lit(0))).alias("start")).distinct()
    # equal names are graded once, for all their codes
    names = once.select("card").distinct()
    words = names.select("card", F.explode(F.array_distinct(F.transform(E.kind_words(F.col("card")), start))).alias("start"))
    same = kinds.select("kind", _letters(F.col("kind")).alias("letters")).filter("letters <> ''").distinct()
    pairs = first.join(words, "start").select("kind", "card").union(same.join(names.select("card", _letters(F.col("card")).alias("letters")), "letters").select("kind", "card")).distinct()
    exact = (_letters(F.col("kind")) == _letters(F.col("card"))) & (_letters(F.col("kind")) != "")
    graded = pairs.withColumn("exact", exact).withColumn("match", F.when(F.col("exact"), 1.0).otherwise(E.name_match(F.col("kind"), F.col("card")))).filter(F.col("match") >= least).join(once, "card")
    of_kind = Window.partitionBy("kind")
    placed = graded.withColumn("place", F.row_number().over(of_kind.orderBy(F.desc("exact"), F.desc("match"), "code"))).withColumn("found", F.count("*").over(of_kind))
    kept = placed.filter(F.col("place") <= most)
    return kinds.join(kept, "kind").select("q", "place", "code", F.col("card").alias("name"), F.round("match", 6).alias("match"), "exact", "found", (F.col("found") > most).alias("cut"))
