"""Column functions that bring names, marks and numbers to a comparable form.

All are built-in expressions, so they stay in generated code. Empty and missing
values are both null here; the report alone writes a dash for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"

# Cyrillic letters that look like Latin ones, and those.
LOOKALIKE_CYRILLIC = "АВЕКМНОРСТУХавекмнорстух"
LOOKALIKE_LATIN = "ABEKMHOPCTYXabekmhopctyx"

# Transliteration of Cyrillic letters.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# In a phonetic key this letter sounds otherwise, and these pairs are one sound, in this order.
PHONETIC_LETTERS = TRANSLITERATION | {"ц": "c"}
PHONETIC_PAIRS = (
    ("qu", "kv"), ("ck", "k"), ("ch", "h"), ("sh", "s"), ("zh", "z"), ("ph", "f"),
    ("c", "k"), ("w", "v"), ("x", "ks"), ("y", "i"), ("ee", "i"), ("oo", "u"),
)

# Legal forms and what they count as; words that end a foreign company's name; abbreviations.
LEGAL_FORMS = {
    "ооо": "ооо", "ао": "ао", "зао": "ао", "оао": "ао", "пао": "ао", "ип": "ип",
    "фгуп": "гуп", "гуп": "гуп", "муп": "гуп", "ано": "ано",
}
MORE_FORMS = ("нао", "уп", "чп", "тоо")
FOREIGN_ENDINGS = (
    "лтд", "ltd", "limited", "лимитед", "гмбх", "gmbh", "ко", "co", "corp", "корпорейшн", "инк", "inc",
    "llc", "srl", "spa", "ag", "bv", "nv", "sa", "as", "компани", "company",
)
ABBREVIATIONS = {
    "нпф": "научнопроизводственнаяфирма",
    "нпо": "научнопроизводственноеобъединение",
    "нпп": "научнопроизводственноепредприятие",
    "нпк": "научнопроизводственнаякомпания",
    "пкф": "производственнокоммерческаяфирма",
    "тд": "торговыйдом",
}


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(c), lambda x: then(x)), F.lit(0))


def tidy(c: Column) -> Column:
    """Trimmed, inner white space single, no-break spaces plain."""
    return F.trim(F.regexp_replace(F.translate(c, "  ", "  "), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    """A tidy text; nothing left is null."""
    return F.when(tidy(c) != "", tidy(c))


def or_dash(c: Column) -> Column:
    """The report's form of a text: a dash where there is none."""
    return F.coalesce(blank_to_null(c.cast("string")), F.lit(DASH))


def latinised(c: Column) -> Column:
    """Cyrillic letters that look like Latin ones as those."""
    return F.translate(c, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN)


def folded(c: Column) -> Column:
    """Lower case, with one letter for е and ё."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def name_key(c: Column) -> Column:
    """Lower-case words of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(folded(c), "[^a-zа-я0-9]+", " "))


def mark_key(c: Column) -> Column:
    """Letters and digits of a mark alone, look-alikes as Latin."""
    return F.regexp_replace(folded(latinised(c)), "[^a-zа-я0-9]+", "")


def number_key(c: Column) -> Column:
    """A registration number as letters, digits, slash and hyphen, look-alikes as Latin."""
    return F.regexp_replace(latinised(folded(c)), "[^0-9a-zа-я/-]+", "")


def flat(c: Column) -> Column:
    """Words of letters and digits between single spaces, one at each end too."""
    return F.concat(F.lit(" "), name_key(c), F.lit(" "))


def transliterated(c: Column, letters: dict[str, str] = TRANSLITERATION) -> Column:
    """Lower case with Cyrillic letters written as Latin ones."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), letters.items(), F.lower(c))


def latin_key(c: Column) -> Column:
    """Transliterated letters and digits alone."""
    return F.regexp_replace(transliterated(c), "[^a-z0-9]+", "")


def phonetic(c: Column) -> Column:
    """How a name sounds: transliterated, sounds of one kind made one, doubles single."""
    plain = F.regexp_replace(transliterated(c, PHONETIC_LETTERS), "[^a-z0-9]+", "")
    one = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), PHONETIC_PAIRS, plain)
    return F.regexp_replace(one, r"(.)\1+", "$1")


def words(c: Column) -> Column:
    """Words of letters and digits, as an array."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9A-Za-zА-Яа-яЁё]+"), F.lit(0))


def phonetic_words(c: Column) -> Column:
    """Phonetic keys of a text's words, joined by single spaces."""
    return F.array_join(F.filter(F.transform(words(c), phonetic), lambda w: w != ""), " ")


def _company_words(c: Column) -> Column:
    return F.split(name_key(c), " ")


def legal_form(c: Column) -> Column:
    """The kind of the first legal form in a company's name, empty without one."""
    kinds = F.create_map(*[F.lit(x) for pair in LEGAL_FORMS.items() for x in pair])
    first = F.get(F.filter(_company_words(c), lambda w: w.isin(*LEGAL_FORMS)), 0)
    return F.coalesce(kinds[first], F.lit(""))


def company_core(c: Column) -> Column:
    """A company's name without its first legal form and foreign endings, abbreviations written out."""
    every = _company_words(c)
    at = F.aggregate(
        F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        F.lit(-1),
        lambda found, x: F.when((found < 0) & x["w"].isin(*LEGAL_FORMS), x["i"]).otherwise(found),
    )
    left = F.filter(every, lambda w, i: (i != at) & ~w.isin(*FOREIGN_ENDINGS))
    longer = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(left, lambda w: F.coalesce(longer[w], w)), "")


def producer_key(c: Column) -> Column:
    """Letters and digits of a producer's name without any legal form."""
    return F.array_join(F.filter(_company_words(c), lambda w: ~w.isin(*LEGAL_FORMS, *MORE_FORMS)), "")


def group_key(c: Column) -> Column:
    """What spellings of one producer share: the producer key with look-alikes as Latin."""
    return latinised(producer_key(c))


def money(c: Column) -> Column:
    """A number written with spaces between thousands and a comma or point, to the cent."""
    return F.round(F.replace(F.translate(F.translate(c, "   ", "   "), " ", ""), F.lit(","), F.lit(".")).try_cast("double"), 2)


def date(c: Column) -> Column:
    """A date written as yyyy-MM-dd, with or without a time, or dd.MM.yyyy; null if there is no such day."""
    text = F.trim(c)
    iso = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    local = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("dd.MM.yyyy"))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}"), local)).cast("date")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian word form that goes with a number."""
    last, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)
