"""Lists of models and articles within names, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import evidence as E
from . import identifiers as I
from . import marks as M
from . import normalise as N

# What heads a list of models in a registered name, and what an item of one looks like.
LIST_HEAD = r"(?iU)(?:в\s+)?(?:модел[ьия]\w*|исполнени\w*|вариант\w*(?:\s+исполнени\w*)?)\s*[:\-–]?\s+"
LIST_ITEM = r"(?U)^(?=[\w\-./]*[A-Za-zА-ЯЁа-яё])[A-ZА-ЯЁ0-9][\w\-./]{0,20}$"
# How a registry text names variants in a line of their own or within one, and what isn't one.
VARIANT_INLINE = r"(?iU)(?:сери[ияй]|вариант\w*\s+исполнени\w*)\s*[:\-–]?\s*([^,;.\n]{1,40})"
VARIANT_LINE = r"(?imU)^\s*(?:[IVX]{1,4}\.|\d{1,2}\.)\s*(.{3,120}?)\s*(?:,\s*в\s+составе.*)?$"
STANDARD = r"(?iU)\s*(?:по\s+)?\b(?:ГОСТ|ОСТ|РСТ)\b(?:\s+РФСР|\s+Р\b)?[\w\s.\-]{0,25}\d{3,}[\w.\-]*\s*"
NO_VARIANT = r"(?iU)\d\s*шт\b|\bшт\.?\b|\bсостав|\bэкз\b|руководств|паспорт|инструкц|упаков"
DESCRIBED = r"(?iU)\b(?:" + "|".join(M.DESCRIPTIVE_WORDS) + r")\b"
MARKUP = {"&nbsp;": " ", "\u00a0": " ", "&quot;": '"', "&laquo;": "«", "&raquo;": "»", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
#: What stands around an item.
LIST_EDGE = "^[ .«»\"'()]+|[ .«»\"'()]+$"


def first_run(items: Column, good) -> Column:
    """The first unbroken run of items that are good."""

    def after(flags: Column) -> Column:
        first = F.array_position(flags, True).cast("int")
        rest = F.slice(flags, F.greatest(first, F.lit(1)), F.size(flags))
        stop = F.array_position(rest, False).cast("int")
        return F.when(first > 0, F.slice(items, first, F.when(stop > 0, stop - 1).otherwise(F.size(rest)))).otherwise(F.array().cast("array<string>"))

    return N.let(F.transform(items, good), after)


def named_variants(name: Column) -> Column:
    """The models that a registered name lists, to the first item that is none; two at least, each once in any case."""
    text = F.coalesce(name, F.lit(""))
    head = F.regexp_extract(text, LIST_HEAD, 0)
    tail = F.substr(text, F.regexp_instr(text, F.lit(LIST_HEAD)) + F.length(head))
    items = F.transform(F.split(tail, "[,;]"), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), LIST_EDGE, ""))
    none = F.array().cast("array<string>")
    run = N.let(items, lambda vs: I.first_of_case(first_run(vs, lambda v: v.rlike(LIST_ITEM))))
    return N.let(F.when(head != "", run).otherwise(none), lambda out: F.when(F.size(out) >= 2, out).otherwise(none))


def _without_type(text: Column, hints: Column) -> Column:
    """A text without the words that begin like those of the hints, endings aside."""
    long_words = F.filter(F.flatten(F.transform(hints, lambda h: I.every(h, "[А-Яа-яЁёA-Za-z]{4,}"))), lambda w: F.length(w) >= 4)
    stems = F.transform(long_words, lambda w: F.lower(F.when(F.length(w) > 5, F.left(w, F.length(w) - 2)).otherwise(w)))
    typed = lambda w: F.exists(stems, lambda s: F.startswith(F.lower(w), s))
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~typed(w)), " ")


def _variant(said: Column, hints: Column | None) -> Column:
    """What is left of a variant's name without standards, numbers and contents; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(said, E.SPECIFICATION_ANY, " "), STANDARD, " ")
    bare = bare if hints is None else _without_type(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), hints)
    for pattern in (r"(?iU)\s*[-–]\s*\d+\s*шт\.?.*$", r"(?iU)\s*,?\s*в\s+состав\w*.*$"):
        bare = F.regexp_replace(bare, pattern, "")
    tidy = F.regexp_replace(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), "^[ ,;:.–—/\"'«»-]+|[ ,;:.–—/\"'«»-]+$", "")
    tidy = F.regexp_replace(tidy, r"^\d{1,2}\s*[.)]\s*", "")

    def judged(v: Column) -> Column:
        signs = lambda sign: F.length(v) - F.length(F.replace(v, F.lit(sign), F.lit("")))
        whole = F.when(signs("(") == signs(")") + 1, F.concat(v, F.lit(")"))).otherwise(v)
        return N.let(whole, lambda w: F.when(F.length(w).between(2, 40) & ~w.rlike("^[a-zа-яё]") & ~w.rlike(NO_VARIANT) & I.looks_like_mark(w) & ~w.rlike(DESCRIBED), w))

    return N.let(tidy, judged)


def described_variants(description: Column, hints: Column | None = None, most: int = 12) -> Column:
    """The variants that a registry text describes, each once in any case, the first `most`.

    Those named within a line come first; numbered lines are read where there are fewer than two.
    """
    text = F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", "\n")
    for written, sign in MARKUP.items():
        text = F.replace(text, F.lit(written), F.lit(sign))
    text = F.regexp_replace(F.translate(text, "\r", "\n"), "[ \t]+", " ")
    good = lambda found: F.filter(F.transform(found, lambda v: _variant(v, hints)), lambda v: v.isNotNull())
    within = lambda t: I.first_of_case(good(I.every(t, VARIANT_INLINE, 1)))
    lined = lambda t: good(I.every(t, VARIANT_LINE, 1))
    both = N.let(text, lambda t: N.let(within(t), lambda f: F.when(F.size(f) < 2, I.first_of_case(F.concat(f, lined(t)))).otherwise(f)))
    return F.slice(both, 1, most)


def registry_list(listed: Column, name: Column) -> Column:
    """A record's variants, parted by semicolons, or those that its name lists if they are more."""
    own = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")
    return N.let(F.struct(own.alias("own"), named_variants(name).alias("named")), lambda s: F.when(F.size(s["named"]) > F.size(s["own"]), s["named"]).otherwise(s["own"]))


def before_articles(text: Column, articles: Column) -> Column:
    """A text up to the last colon, comma or semicolon before its first article, or up to the article; the text itself if nothing is left."""
    first = F.get(articles, F.lit(0))
    at = F.instr(text, first)
    head = F.left(text, at - 1)
    cut = N.let(F.regexp_extract(head, r"(?s)^(.+)[:,;]", 1), lambda c: F.regexp_replace(F.when(c != "", c).otherwise(head), "^[ ,;:.–—-]+|[ ,;:.–—-]+$", ""))
    return N.let(cut, lambda c: F.when(first.isNotNull() & (at > 1) & (c != ""), c).otherwise(text))


def without_twins(value: Column) -> Column:
    """The words of a mark, of two of one family with and without a number only the numbered, where the first stood."""

    known = lambda w: F.struct(w.alias("w"), M.family_root(w).alias("root"), w.rlike(r"\d").alias("numbered"))
    words = F.transform(F.filter(F.split(F.trim(F.coalesce(value, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), known)
    long_root = lambda x: F.length(x["root"]) >= 4

    def put(keep: Column, word: Column) -> Column:
        alike = lambda k: F.startswith(k["root"], word["root"]) | F.startswith(word["root"], k["root"])
        twin = F.transform(keep, lambda k: long_root(k) & long_root(word) & alike(k) & (k["numbered"] != word["numbered"]))
        numbered = lambda place: F.transform(keep, lambda k, i: F.when((i + 1 == place) & word["numbered"], word).otherwise(k))
        return N.let(F.array_position(twin, True), lambda place: F.when(place > 0, numbered(place)).otherwise(F.concat(keep, F.array(word))))

    none = F.array().cast("array<struct<w:string,root:string,numbered:boolean>>")
    folded = F.array_join(F.transform(F.aggregate(words, none, put), lambda x: x["w"]), " ")
    return F.when(F.size(words) < 2, value).otherwise(folded)
