"""Column functions that find identifiers, marks and evidence in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalise as N

# What starts the name of a service rather than of goods.
SERVICES = (
    r"(?iu)^\s*(?:оказание\s+услуг|услуг[аи]?(?![а-яё])|техническо[ем]\s+обслуживани|обслуживани|ремонт|контроль\s+технического|"
    r"поверк|калибровк|монтаж|пусконаладк|демонтаж|утилизац|аренд|поставка\s+запасных|"
    r"(?:текущ|капитальн|планов|внепланов|аварийн|срочн)[а-яё]*\s+ремонт)"
)
CATALOGUE_CODE = r"(?<![0-9.])\d{2}\.\d{2}\.\d{2}\.\d{3}-\d{4,8}(?![0-9])"
REGISTRATION = r"(?iu)(?<![а-яёa-z0-9])(РЗН|ФСЗ|ФСР|ФС)\s*[-–]?\s*№?\s*(\d{4})\s*/\s*(\d{2,})"
OLD_REGISTRATION = r"(?iu)(?<![а-яёa-z0-9])МЗ\s*РФ\s*№?\s*(\d{2,4})\s*/\s*(\d{2,6})(?!\d)"
SPECIFICATION = r"(?iu)(?<![а-яёa-z0-9])ТУ\s*[-–]?\s*№?\s*(\d[\d.]*(?:\s*[-–]\s*[\da-zа-яё]+){2,})"
MEASURE = r"(?iu)^(?:(?:[dhlwдøØ⌀]|диам(?:етр)?[а-яё]*)\s*[=:]?\s*\d+(?:[.,]\d+)?\s*(?:мм|см|мкм|нм|м|дюйм[а-яё]*|fr|шр|°|град(?:ус[а-яё]*)?)?|\d+(?:[.,]\d+)?\s*(?:мм|см|мкм|нм|м|дюйм[а-яё]*|fr|шр|°|град(?:ус[а-яё]*)?))$"
# Trade marks that are none.
NO_TRADEMARK = r"(?iu)^(?:отсутству|не\s*установл|не\s*указан|нет(?![а-яё])|-|—|n/?a$|свидетельств|сертификат|№\s*\d|рег[а-яё]*\s*(?:номер|№)|номер\s+(?:госуд|регистр))"
BARE_NUMBER = r"(?iu)^(?:№|n|no|поз\.?|п\.?)?\s*[\d\s.\-/]{1,20}$"
SPECIFIC = r"(?iu)[<>]=|≥|≤|кгс/см|мм рт|,\s*кг(?![а-яё])|вольт(?![а-яё])|гц(?![а-яё])"
FLAGS = ("false", "true", "0", "1", "да", "нет")
NOT_A_MARK = ("FALSE", "TRUE", "NULL", "NONE", "NAN", "N/A", "NA", "ЗАМЕНА", "НЕТ", "ОТСУТСТВУЕТ", "ОТСУТСТВУЮТ", "НЕ ТРЕБУЕТСЯ", "НЕ ТРЕБУЮТСЯ", "Б/Н", "БЕЗ НОМЕРА", "НЕ УКАЗАНО", "НЕ ПРИМЕНИМО")
TOKEN_STOP = ("ту", "ру", "гост", "исо", "iso", "тип", "мм", "см", "шт", "кг", "мл", "гц", "вт", "ip", "n", "no", "рзн", "фсз", "фср")
KEY_STOP = (
    "с", "и", "для", "по", "в", "на", "из", "принадлежностями", "принадлежности", "вариант", "варианты", "исполнения",
    "исполнение", "модели", "модель", "медицинский", "медицинская", "медицинское", "ту", "тип", "виды",
)


def every(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def first_of_case(texts: Column) -> Column:
    """Texts that differ in more than case, the first of each."""
    once = lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, F.lower), F.lower(t)) == i + 1)
    return N.let(texts, once)


def is_service(name: Column) -> Column:
    return F.coalesce(name.rlike(SERVICES), F.lit(False))


def catalogue_codes(c: Column) -> Column:
    """Distinct catalogue codes in order of their first place."""
    return F.array_distinct(every(c, CATALOGUE_CODE))


def near_codes(c: Column) -> Column:
    """Distinct pieces with digits and points that are not quite catalogue codes."""
    cut = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"), lambda t: F.regexp_replace(t, "^[ .,;:—–-]+|[ .,;:—–-]+$", ""))
    return F.array_distinct(F.filter(cut, lambda t: t.rlike(r"\d") & t.contains(".") & ~t.rlike(CATALOGUE_CODE)))


def purchase_number(c: Column) -> Column:
    """The first 19 digits, null if there are fewer."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 19, F.substring(digits, 1, 19))


def kind_codes(c: Column) -> Column:
    """Distinct tokens of 3 to 8 digits."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"), lambda t: t.rlike(r"^\d{3,8}$")))


def registrations(c: Column) -> Column:
    """Distinct registration numbers in one form, the present kinds before the old one."""
    now = F.transform(every(c, REGISTRATION), lambda t: F.concat(F.upper(F.regexp_extract(t, REGISTRATION, 1)), F.lit(" "), F.regexp_extract(t, REGISTRATION, 2), F.lit("/"), F.regexp_extract(t, REGISTRATION, 3)))
    old = F.transform(every(c, OLD_REGISTRATION), lambda t: F.concat(F.lit("МЗ РФ № "), F.regexp_extract(t, OLD_REGISTRATION, 1), F.lit("/"), F.regexp_extract(t, OLD_REGISTRATION, 2)))
    return F.array_distinct(F.concat(now, old))


def main_registration(text: Column, hint: Column, reach: int = 160) -> Column:
    """Of several registration numbers, that which the most words of the hint (over 3 letters) precede closely; the first of equals."""
    wanted = F.filter(F.split(N.name_key(hint), " "), lambda w: F.length(w) > 3)

    numbers = registrations(text)
    upper = F.upper(text)
    scored = F.transform(
        numbers,
        lambda n, i: F.struct(
            F.size(F.filter(wanted, lambda w: F.contains(N.name_key(F.right(F.split_part(upper, n, F.lit(1)), F.lit(reach))), w))).alias("score"),
            (-i).alias("order"),
            n.alias("number"),
        ),
    )
    return F.array_max(scored)["number"]


def specification(c: Column) -> Column:
    """The number of technical specifications, split digits healed and dashes made one."""
    healed = F.regexp_replace(c, r"(?<=\d)[\s ]+(?=\d{2,}\s*[-–])", "")
    bare = F.regexp_replace(F.regexp_extract(healed, SPECIFICATION, 1), r"[\s ]+", "")
    tidy = F.regexp_replace(F.translate(bare, "–—−", "---"), r"(?<=\d{4})[A-Za-zА-ЯЁа-яё]$", "")
    tidy = F.regexp_replace(tidy, r"^[ .-]+|[ .-]+$", "")
    return F.when(tidy != "", tidy)


def is_measure(c: Column) -> Column:
    """A size: a number with a unit, or with the sign of a diameter; a bare number is none."""
    return F.coalesce(F.trim(c).rlike(MEASURE), F.lit(False))


def is_trademark(c: Column) -> Column:

    def fits(tidy: Column) -> Column:
        colons = F.length(tidy) - F.length(F.replace(tidy, F.lit(":"), F.lit("")))
        return (
            F.length(tidy).between(2, 120)
            & ~F.lower(tidy).isin(*FLAGS)
            & ~tidy.rlike(SPECIFIC)
            & (colons < 2)
            & ~tidy.rlike(NO_TRADEMARK)
            & ~tidy.rlike(BARE_NUMBER)
        )

    return N.let(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), fits)


def looks_like_mark(c: Column) -> Column:
    """At most 60 characters and 5 words, no stop word, year or number, with a Latin letter, a digit, capitals or an inner capital."""
    tidy = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    sign = tidy.rlike(r"[A-Za-z]") | tidy.rlike(r"\d") | tidy.rlike(r"(?u)[А-ЯЁ]{2,}") | tidy.rlike(r"(?u)[а-яё][А-ЯЁ]")
    return (
        (tidy != "")
        & (F.length(tidy) <= 60)
        & (F.size(F.split(tidy, " ")) <= 5)
        & ~F.upper(tidy).isin(*NOT_A_MARK)
        & ~tidy.rlike(r"(?iu)^(?:19|20)\d{2}\s*(?:г|год[а-яё]*)?\.?$")
        & ~tidy.rlike(r"^[\d\s.,/-]+$")
        & sign
    )


def article_keys(c: Column) -> Column:
    """Distinct article designations of a text: words with a digit, and short words of letters joined to the number beside them."""
    text = F.coalesce(c, F.lit(""))
    single = F.transform(N.words(text), N.latin_key)
    # every other pair could hide behind an overlap, so pairs are looked for from each word's start
    glued = F.transform(every(text, r"(?<![0-9A-Za-zА-Яа-яЁё])[A-Za-zА-Яа-яЁё]{1,5}[ \-‑–]?(?=(\d[0-9A-Za-zА-Яа-яЁё]*))(\d[0-9A-Za-zА-Яа-яЁё]*)"), N.latin_key)
    return F.array_distinct(F.filter(F.concat(single, glued), lambda k: k.rlike(r"\d")))


def phrase_articles(c: Column) -> Column:
    """Articles of a search phrase, in order."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<![0-9A-Za-zА-Яа-яЁё])([A-Za-zА-Яа-яЁё]{1,5})[ \-‑–](?=\d)", "$1")
    return F.filter(F.transform(N.words(joined), N.latin_key), lambda k: k.rlike(r"\d"))


def phrase_names(c: Column) -> Column:
    """Phonetic keys of the words of a search phrase that have three letters and no digit."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<![0-9A-Za-zА-Яа-яЁё])([A-Za-zА-Яа-яЁё]{1,5})[ \-‑–](?=\d)", "$1")
    names = F.filter(N.words(joined), lambda w: ~N.latin_key(w).rlike(r"\d") & (F.length(N.latin_key(w)) >= 3))
    return F.transform(names, N.phonetic)


def quote_supported(quote: Column, text: Column) -> Column:
    """Whether at least half of a quotation's words of four letters are in the text; with none, whether all of it is."""

    def found(t: Column) -> Column:
        hits = F.size(F.filter(t["words"], lambda w: F.contains(t["hay"], w)))
        whole = (t["said"] != "") & F.contains(t["hay"], t["said"])
        return (t["hay"] != "") & F.when(F.size(t["words"]) > 0, 2 * hits >= F.size(t["words"])).otherwise(whole)

    # each key is taken once and not once a word
    words = lambda k: F.struct(k["hay"].alias("hay"), k["said"].alias("said"), F.filter(F.split(k["said"], " "), lambda w: F.length(w) >= 4).alias("words"))
    keys = F.struct(N.name_key(text).alias("hay"), N.name_key(quote).alias("said"))
    return F.coalesce(N.let(keys, lambda k: N.let(words(k), found)), F.lit(False))


def strong_tokens(c: Column) -> Column:
    """Distinct telling tokens by kind: quoted, Latin words, Cyrillic capitals, with digits."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), REGISTRATION, " "), r"(?iu)(?<![а-яё])ТУ\s*[-–]?\s*№?\s*\d[\d.]*(?:\s*[-–]\s*[\dа-яёa-z]+)+", " ")
    kinds = F.concat(
        every(text, r"[«\"']([^«»\"']{2,40})[»\"']", 1),
        every(text, r"[A-Za-z]{3,}"),
        every(text, r"(?<![А-ЯЁа-яё])[А-ЯЁ]{2,}(?:[-–][А-ЯЁа-яё]+)?(?![А-ЯЁа-яё])"),
        every(text, r"(?U)\b[\w-]*\d[\w-]*\b"),
    )
    tidy = F.filter(F.transform(kinds, lambda t: F.regexp_replace(t, "^[-– ]+|[-– ]+$", "")), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*TOKEN_STOP))
    return first_of_case(tidy)


def key_tokens(c: Column) -> Column:
    """Distinct tokens of three characters that are not stop words."""
    return F.array_distinct(F.filter(every(N.folded(c), r"[a-zа-я0-9\-]{3,}"), lambda t: ~t.isin(*KEY_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def masked(text: Column, number: Column) -> Column:
    """The text with each occurrence of a number, in any case, put out of sight."""
    return F.when(F.length(number) > 0, F.regexp_replace(text, F.concat(F.lit(r"(?iu)\Q"), number, F.lit(r"\E")), F.lit("…"))).otherwise(text)


# Attachment kinds by file name.
EXCLUDED_FILES = r"(?iu)платёжн|платежн|поручени|(?<![а-яё])о\s*при[её]мк|UPD_|извещени|протокол|накладн|(?<![а-яё])сч[её]т(?:а|ах|ам|ов|у|е|ом)?(?![а-яё])|(?<![а-яё])акт(?:а|ы|ов|у|е|ом)?(?![а-яё])"
AMENDMENT_FILES = r"(?iu)^\s*(?:доп[а-яё]*\.?\s*соглашени|дс\s*№?\s*\d)"
AMENDED_FILES = r"(?iu)с\s*уч[её]том\s*доп[а-яё]*\.?\s*соглашени[а-яё]*\s*([\d,\s]*)"


def clean_file_name(c: Column) -> Column:
    """A file name without the size in brackets after it."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?iu)\s*\(\s*[\d\s., ]+\s*(?:[кмгт]?б|[kmgt]?b|байт|bytes?)\.?\s*\)\s*$", ""))


def attachment_rank(c: Column) -> Column:
    """How well a file stands for its contract: the latest amended text, the electronic contract, any contract; -1 for others."""
    numbers = F.transform(every(F.regexp_extract(c, AMENDED_FILES, 1), r"\d+"), lambda n: n.cast("int"))
    return F.coalesce(
        F.when(~c.rlike(r"(?i)\.xml\s*$") | c.rlike(EXCLUDED_FILES) | c.rlike(AMENDMENT_FILES), -1)
        .when(c.rlike(AMENDED_FILES), 1000 + F.coalesce(F.array_max(numbers), F.lit(1)))
        .when(c.rlike(r"(?iu)электронн[а-яё]*\s*контракт"), 500)
        .when(c.rlike(r"(?iu)(?<![а-яё])контракт"), 100)
        .otherwise(-1),
        F.lit(-1),
    ).cast("int")


def starting_price(prices: Column) -> Column:
    """One distinct positive price is the starting price; of several none is, and a note says so."""
    known = F.array_distinct(F.filter(prices, lambda p: p > 0))
    return F.struct(
        F.when(F.size(known) == 1, known[0]).alias("value"),
        F.when(F.size(known) > 1, F.lit("совместная закупка: начальных цен несколько")).otherwise(F.lit("")).alias("note"),
    )
