"""Column functions for companies' names: tidy spellings, keys, and whether two names are one company.

All are built-in expressions over arrays of words, so comparisons stay in generated
code and can be join conditions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalise as N

# How a country is written after a company's name, as beginnings of words.
COUNTRIES = (
    r"Российск\w+\s+Федерац\w+", r"Росси\w+", r"Китайск\w+\s+Народн\w+\s+Республик\w+", r"Китайск\w+", r"Кита[йя]",
    r"Республик\w+\s+Беларус\w+", r"Беларус\w+", r"Республик\w+\s+Корея", r"Южн\w+\s+Корея", r"Корея",
    r"Соединённ\w+\s+Штат\w+(?:\s+Америки)?", r"США", r"Федеративн\w+\s+Республик\w+\s+Герман\w+", r"Герман\w+", r"Итали\w+",
    r"Япони\w+", r"Тайвань", r"Инди\w+", r"Турци\w+", r"Швейцари\w+", r"Казахстан\w*", r"Польш\w+", r"Чехи\w+", r"Франци\w+",
    r"Великобритани\w+", r"Испани\w+", r"Нидерланд\w+", r"Финлянди\w+", r"Швеци\w+", r"Австри\w+", r"Венгри\w+",
)
# Words that are a country by themselves.
COUNTRY_WORD = (
    r"(?iU)^(?:росси\w*|рф|кита\w*|герман\w*|итали\w*|япони\w*|коре\w*|тайван\w*|инди\w*|турци\w*|сша|швейцари\w*|беларус\w*|"
    r"казахстан\w*|польш\w*|чехи\w*|франци\w*|великобритани\w*|нидерланд\w*|финлянди\w*|словаки\w*|russia|china|germany|italy|japan|korea|usa)$"
)
# What names a company, introduces one, or rules one out.
HOME_FORMS = ("ООО", "ОАО", "ЗАО", "ПАО", "АО", "НАО", "ИП", "НПО", "НПП", "НПФ", "НПЦ", "ФГУП", "ГУП", "МУП", "АНО", "НКО", "КБ", "ТД")
FOREIGN_FORMS = (
    "Co", "Ltd", "Limited", "LLC", r"L\.L\.C", "Inc", "Corp", "Corporation", "Company", "GmbH", "AG", r"S\.?p\.?A", r"S\.?r\.?[lo]",
    r"S\.?A\.?S", "SARL", r"B\.?V", r"N\.?V", "A/S", "Oy", "AB", "Kft", r"Sp\.\s*z\s*o\.?o", "Pvt", "KG", "Лтд", "Лимитед", "ГмбХ",
    "Корпорейшн", "Компани", "Ко", r"с\.?р\.?о", r"а\.?с",
)
COMPANY_FORM = r"(?iU)(?:^|[\s\"'«(])(?:" + "|".join(HOME_FORMS) + r")(?:[\s\"'»).,]|$)|\b(?:" + "|".join(FOREIGN_FORMS) + r")\b"
MAKER_LABEL = r"(?iu)(?:производител[ья]|изготовител[ья]|manufacturer)\s*[:：]"
NO_COMPANY = (
    r"(?iu)^\(?\d|показател|характеристик|требован|объекта\s+закупки|"
    r"^(?:кита[йя]|росси|герман|итал|япон|коре|тайван|инди|турци|швейцар|сша|беларус|казахстан|польш|чеш|франц|британ|нидерланд)"
)
BARE_FORM = r"(?iu)^(?:ип|ооо|оао|зао|пао|ао|нао|фгуп|гуп|муп|ано)\.?$"

#: What may follow a name and says nothing of it: signs, a country with its code, a country after a slash or a comma.
_TAIL = (
    r"(?iU)(?:[ ,;.]|[,;]?\s[^\"()]{0,40}\(\d{3}\)|\s*/\s*[а-яёa-z][а-яёa-z\s.-]{1,28}|[,;]\s*(?:" + "|".join(COUNTRIES) + r"))+$"
)
_KEY_LEAST = 6


def unwrapped(c: Column) -> Column:
    """A name without the quotes that enclose all of it; quotes inside stay."""
    return F.trim(F.regexp_replace(F.trim(c), '^"([^"]+)"$|^«([^«»]+)»$', "$1$2"))


def clean_company(c: Column) -> Column:
    """A company's name without country, stray signs and enclosing quotes, a lost closing quote put back; tidy names stay as they are."""
    tidy = unwrapped(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    bare = F.regexp_replace(F.regexp_replace(tidy, r"^[ ,;.]+", ""), _TAIL, "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return unwrapped(F.when(quotes % 2 == 1, F.concat(bare, F.lit('"'))).otherwise(bare))


def company_keys(c: Column) -> Column:
    """The cores of a name, of what stands outside brackets and inside each, where they have six letters."""
    text = F.coalesce(c, F.lit(""))
    inside = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    chunks = F.concat(F.array(F.regexp_replace(text, r"\([^)]*\)", " ")), inside)
    return F.array_distinct(F.filter(F.transform(chunks, N.company_core), lambda k: F.length(k) >= _KEY_LEAST))


def without_country(c: Column) -> Column:
    """A name without the countries that end it."""
    words = F.split(F.trim(c), r"\s+")
    foreign = F.transform(words, lambda w: F.regexp_replace(w, "^[ ,\"'«»()]+|[ ,\"'«»()]+$", "").rlike(COUNTRY_WORD))
    last = F.aggregate(foreign, F.struct(F.lit(0).alias("i"), F.lit(0).alias("keep")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when(x, a["keep"]).otherwise(a["i"] + 1).alias("keep")))
    return F.array_join(F.slice(words, F.lit(1), last["keep"]), " ")


def _telling_words(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)^\s*(?:ООО|ОАО|ЗАО|АО|ПАО|НАО|УП|ЧП|ИП)\b\.?", " ")
    found = F.regexp_extract_all(bare, F.lit("[А-Яа-яЁёA-Za-z]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*N.FOREIGN_ENDINGS))


def _initials(words: Column) -> Column:
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def is_initialism(short: Column, full: Column) -> Column:
    """Whether a name is the initials of another, or of its first words followed by the same last ones."""
    a, b = _telling_words(short), _telling_words(full)
    first, rest = F.coalesce(F.get(a, F.lit(0)), F.lit("")), F.greatest(F.size(a) - 1, F.lit(0))
    capital = first.rlike("^[A-ZА-ЯЁ]+$")
    whole = (F.size(a) == 1) & (F.size(b) >= 2) & (F.length(first) >= 3) & capital & (first == _initials(b))
    cut = F.greatest(F.size(b) - rest, F.lit(0))
    head, tail = F.slice(b, F.lit(1), cut), F.slice(b, cut + 1, rest)
    ends = F.slice(a, F.lit(2), rest)
    low = lambda ws: F.transform(ws, F.lower)
    headed = (
        (rest > 0) & (F.size(b) >= 3) & (F.size(a) < F.size(b)) & (low(ends) == low(tail)) & (F.length(F.array_join(ends, "")) >= 3)
        & (F.size(head) >= 2) & (F.length(first) >= 2) & capital & (first == _initials(head))
    )
    return F.coalesce(whole | headed, F.lit(False))


def same_company(a: Column, b: Column) -> Column:
    """Whether two names are one company: equal cores, but for a country that one ends with, or initials of the other."""
    x, y = N.company_core(a), N.company_core(b)
    home = N.company_core(without_country(a))
    alike = (x == y) | ((home != "") & (home == N.company_core(without_country(b)))) | is_initialism(a, b) | is_initialism(b, a)
    return F.coalesce((x != "") & (y != "") & alike, F.lit(False))


def is_company_name(value: Column, source: Column) -> Column:
    """Whether a value names a company: by its form, or as what a maker's label in the source text introduces."""
    tidy = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    key = F.replace(N.name_key(tidy), F.lit(" "), F.lit(""))
    said = F.regexp_extract(F.coalesce(source, F.lit("")), MAKER_LABEL + r"(?s)(.{0,120})", 1)
    labelled = (key != "") & F.contains(F.replace(N.name_key(said), F.lit(" "), F.lit("")), key)
    return F.length(tidy).between(4, 120) & ~tidy.rlike(NO_COMPANY) & (tidy.rlike(COMPANY_FORM) | labelled)


def mended_form(declarant: Column, producer: Column, *addresses: tuple[Column, Column]) -> Column:
    """A declarant of which only the legal form is left is the producer whose name begins so, if an address of theirs is the same."""
    name, other = F.trim(F.coalesce(declarant, F.lit(""))), F.trim(F.coalesce(producer, F.lit("")))
    same = F.lit(False)
    for mine, theirs in addresses:
        same |= F.coalesce((F.trim(mine) != "") & (F.trim(mine) == F.trim(theirs)), F.lit(False))
    begins = F.startswith(F.lower(other), F.regexp_replace(F.lower(name), r"\.+$", "")) & (other != "")
    return F.when(name.rlike(BARE_FORM) & begins & same, other).otherwise(name)
