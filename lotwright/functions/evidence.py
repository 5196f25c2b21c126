"""Column functions that weigh whether a text and a registry record speak of one device."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import identifiers as I
from . import normalise as N

# Words that say nothing of a kind's name.
KIND_STOP = ("для", "или", "и", "с", "со", "из", "в", "на", "от", "по", "до", "к", "при", "их", "не", "общего", "назначения")
# What a family of articles looks like once letters are Latin, and the numbers that look so but are none.
FAMILY = r"(?U)\b([a-zа-я]{3,6})\s?-\s?(\d{3,5})[a-zа-я0-9-]*\b"
SPECIFICATION_ANY = r"(?iU)\s*(?:по\s+)?\bТУ\s*[-–]?\s*№?\s*[\d\w]+(?:(?:\s*[-–]\s*|\.)[\d\w]+)+\s*"
HYPHENED = r"(?U)\b[А-ЯЁA-Z][а-яёA-Za-z]*[-–][А-ЯЁA-Z0-9][\w\-]*\b"


def tidy(c: Column) -> Column:
    """Lower case with one letter for е and ё, quotes, brackets and signs gone, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(N.folded(F.coalesce(c, F.lit(""))), r"[\"'«»()\[\]®™]", " "), r"\s+", " "))


# --- names of kinds ---


def kind_words(c: Column) -> Column:
    """The words of a kind's name, longer than two letters and no stop words."""
    return F.filter(F.split(N.name_key(F.coalesce(c, F.lit(""))), " "), lambda w: (F.length(w) > 2) & ~w.isin(*KIND_STOP))


def same_word(a: Column, b: Column) -> Column:
    """Whether two words are equal, or begin alike but for an ending of at most three letters (five letters in common at least)."""
    shorter = F.least(F.length(a), F.length(b))
    stem = F.greatest(F.lit(5), shorter - 3)
    return (a == b) | ((shorter >= 5) & (F.left(a, stem) == F.left(b, stem)))


def name_match(kind: Column, card: Column) -> Column:
    """The larger part of either name's words that the other has, given that it has the kind's first word; else 0."""
    k, c = kind_words(kind), kind_words(card)
    among = lambda words, w: F.exists(words, lambda x: same_word(w, x))
    part = lambda words, others: F.size(F.filter(words, lambda w: among(others, w))) / F.size(words)
    first = (F.size(k) > 0) & (F.size(c) > 0) & F.coalesce(among(c, F.get(k, F.lit(0))), F.lit(False))
    return F.when(first, F.greatest(part(k, c), part(c, k))).otherwise(0.0)


def same_device_kind(registered: Column, kinds: Column) -> Column:
    """Whether a registered name is of one of the kinds: all stems of a short kind are in it, of a longer one the first or any two others."""
    text = tidy(registered)

    def fits(kind: Column) -> Column:
        long_words = F.filter(F.split(tidy(kind), " "), lambda w: F.length(w) > 4)
        stems = F.transform(long_words, lambda w: F.when(F.length(w) > 6, F.left(w, F.length(w) - 2)).otherwise(w))
        held = F.filter(stems, lambda s: F.contains(text, s))
        first = F.coalesce(F.contains(text, F.get(stems, F.lit(0))), F.lit(False))
        others = F.size(F.filter(stems, lambda s, i: (i > 0) & F.contains(text, s)))
        return F.when(F.size(stems) == 0, False).when(F.size(stems) <= 3, F.size(held) == F.size(stems)).otherwise(first | (others >= 2))

    return F.coalesce((text != "") & F.exists(kinds, fits), F.lit(False))


# --- designations ---


def telling_tokens(c: Column) -> Column:
    """The strong tokens of a text and its hyphened names, each once in any case."""
    return I.first_of_case(F.filter(F.concat(I.strong_tokens(c), I.every(c, HYPHENED)), lambda t: F.length(t) >= 2))


def shares_mark(name: Column, registered: Column) -> Column:
    """Whether a name and a registry text share a designation, or the text goes on from the whole name."""
    text = tidy(registered)
    bare = tidy(F.regexp_replace(F.coalesce(name, F.lit("")), I.REGISTRATION, " "))
    whole = (F.length(bare) >= 20) & F.contains(text, bare)
    inside = lambda t: (F.length(t) >= 4) & F.contains(text, t) | F.exists(F.split(t, " "), lambda w: (F.length(w) >= 5) & F.contains(text, w))
    return (text != "") & (whole | F.exists(F.transform(telling_tokens(name), tidy), inside))


def article_families(c: Column) -> Column:
    """Distinct prefix-number pairs, as structs, of the articles in a text; numbers of specifications are none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPECIFICATION_ANY, " "), "<[^>]+>", " ")
    text = F.lower(N.latinised(tidy(bare)))
    pair = lambda m: F.struct(F.regexp_extract(m, FAMILY, 1).alias("family"), F.regexp_extract(m, FAMILY, 2).alias("number"))
    return F.array_distinct(F.transform(I.every(text, FAMILY), pair))


def contradicts(text: Column, registered: Column) -> Column:
    """Whether a family of articles that both texts name has no number in common; silence is no contradiction."""

    def apart(both: Column) -> Column:
        said, held = both["said"], both["held"]
        other = lambda p: F.exists(held, lambda h: h["family"] == p["family"])
        agreed = lambda p: F.exists(said, lambda s: (s["family"] == p["family"]) & F.array_contains(held, s))
        return F.exists(said, lambda p: other(p) & ~agreed(p))

    return N.let(F.struct(article_families(text).alias("said"), article_families(registered).alias("held")), apart)


def evidence(tokens: Column, text: Column, registered: Column) -> Column:
    """Those of the tokens that a registry text has as whole words; none if the texts contradict each other."""
    hay = F.concat(F.lit(" "), N.name_key(N.latinised(registered)), F.lit(" "))
    held = F.filter(tokens, lambda t: F.contains(hay, F.concat(F.lit(" "), N.name_key(N.latinised(t)), F.lit(" "))))
    return F.when(contradicts(text, registered), F.array().cast("array<string>")).otherwise(held)


def same_number(wanted: Column, *held: Column) -> Column:
    """Whether any of a record's numbers is the one wanted, in any spelling."""
    key = N.number_key(F.coalesce(wanted, F.lit("")))
    return (key != "") & reduce(lambda x, y: x | y, [N.number_key(F.coalesce(h, F.lit(""))) == key for h in held])


# --- phrases and replies ---


def phrase_matches(phrase: Column, text: Column) -> Column:
    """Whether a text has every word of a phrase by sound, be it inside a longer word."""
    wanted = F.filter(F.transform(N.words(phrase), N.phonetic), lambda w: w != "")
    sounds = N.phonetic_words(text)
    return (F.size(wanted) > 0) & (sounds != "") & F.forall(wanted, lambda w: F.contains(sounds, w))


def any_match(phrases: Column, text: Column) -> Column:
    """Whether a text matches any of several phrases."""
    return F.coalesce(F.exists(phrases, lambda p: phrase_matches(p, text)), F.lit(False))


def reply_fields(raw: Column) -> Column:
    """The first JSON object of a model's reply as a map, whatever stands around it; an empty map if there is none."""
    flat_object = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*\}", 0)
    return F.coalesce(F.from_json(flat_object, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def variant_supported(variant: Column, quote: Column, text: Column) -> Column:
    """Whether a quote stands in the text and itself names the variant, as an article or part of one."""
    key = N.latin_key(F.coalesce(variant, F.lit("")))
    named = F.exists(I.article_keys(quote), lambda k: F.contains(k, key))
    return F.coalesce((key != "") & (F.trim(quote) != "") & I.quote_supported(quote, text) & named, F.lit(False))
