"""Column functions for marks: what words name a device's type, families of marks, tidy spellings, and why a mark is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import companies as C
from . import identifiers as I
from . import normalise as N

# Words that name a type of device or a part of one.
TYPE_WORDS = (
    r"облучател\w*", r"рециркулятор\w*", r"обеззаражива\w*", r"измерител\w*", r"анализатор\w*", r"монитор\w*", r"комплекс\w*",
    r"стерилизатор\w*", r"автоклав\w*", r"лампы?", r"дозатор\w*", r"ингалятор\w*", r"небулайзер\w*", r"тонометр\w*", r"термометр\w*",
    r"коагулятор\w*", r"стимулятор\w*", r"дефибриллятор\w*", r"отсасыватель\w*", r"насос\w*", r"весы", r"шкафы?", r"кроват\w*",
    r"носилки", r"контейнер\w*", r"сумки?", r"пакеты?", r"бикс\w*", r"ширм\w*", r"знаки?",
)
# Words that describe a device.
DESCRIPTIVE_WORDS = (
    r"кресл\w*", r"камер\w*", r"модул\w*", r"светильник\w*", r"блок\w*", r"столик\w*", r"стол\w*", r"плеч\w*", r"наконечник\w*",
    r"шланг\w*", r"канал\w*", r"бутылк\w*", r"чаш\w*", r"фильтр\w*", r"систем\w*", r"инструмент\w*", r"пистолет\w*", r"микромотор\w*",
    r"скалер\w*", r"компрессор\w*", r"аспиратор\w*", r"педал\w*", r"стойк\w*", r"штатив\w*", r"треног\w*", r"основани\w*",
    r"кронштейн\w*", r"тележк\w*", r"держател\w*", r"подголовник\w*", r"подлокотник\w*", r"принадлежност\w*", r"комплект\w*",
    r"устройств\w*", r"прибор\w*", r"аппарат\w*", r"установк\w*", r"издели\w*", r"состав\w*",
)
# What a document's number begins with; endings and words of a device's name that a mark may begin with.
DOCUMENT_WORDS = ("рзн", "p3h", "p3н", "фсз", "фср", "фс", "ерул", "ру", "ту", "гост", "окпд", "ктру", "нкми", "сгр", "тр")
DEVICE_WORD = (
    r"(?iU)^(?:(?=[а-яё]{6,}$)[а-яё]+(?:тор|ник|льник|арат|ема|граф|метр|скоп|стика)|комплекс|прибор|система|устройство|блок|лампа|"
    r"облучатель|(?=[а-яё]{7,}$)[а-яё]+(?:ая|ый|ое|ой|ые|ий))$"
)
NO_MARK = r"(?iU)^\d+(?:[.,]\d+)?\s+[а-яё]{4,}|^(?:поз|стр|№)\b"
TAIL_WORDS = r"(?iU)\b(?:вариант\w*|исполнени\w*|модел[ьия]\w*|сери[ияй])\b.*$|(?<![\w-])[IVX]{1,4}\.(?![\w-]).*$"
MODEL_LIST = r"(?iU)модел[ияей]{1,2}\s+[^,;.]{1,24},"
ARTICLE = r"(?U)\b[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё]*-?\d[\w-]*"
STANDARD_TAIL = r"(?isU)\s*(?:по\s+)?(?:[A-ZА-Я.\d]+\s*)?\b(?:ТУ|ГОСТ)\b.*$"
TRADEMARK_BOILERPLATE = r"(?iU)\(\s*(?:объект\s+закупки\s+)?явля\w+\s+медицинским\s+издели\w*[^)]*\)?"
TRADEMARK_ABSENT = r"(?iU)товарн(?:ый|ые)\s*знак(?:и)?\s*[:—-]?\s*(?:отсутств\w*|не\s*установл\w*|не\s*указан\w*|нет)\b"

_EDGE = r"^[ .,;:\"'«»()\[\]–—-]+|[ .,;:\"'«»()\[\]–—-]+$"
#: Why a mark is dropped.
IS_COMPANY, IS_NOTHING, IS_DESCRIPTION = "это название завода, а не обозначение", "после вычистки названия прибора не осталось ничего", "это описание изделия или канцелярия, а не марка"
IS_MEASURE, IS_COUNTRY, IS_LIST = "это размер изделия, а не обозначение", "это страна происхождения", "перечень через запятую или оборванная скобка"


def _count(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def spec_sheet(c: Column) -> Column:
    """Whether a text is a sheet of characteristics: signs of limits, or three colons in over 120 characters."""
    text = F.coalesce(c, F.lit(""))
    signs = text.rlike(r"[<>]\s*=") | text.rlike(r"(?iU)\bне\s+(?:менее|более)\b") | text.rlike(r"(?U)\b[Дд][Аа]\b\s*[А-ЯЁ]")
    return signs | ((_count(text, ":") >= 3) & (F.length(text) > 120))


def is_active(status: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(F.trim(status)), F.lit("действ")), F.lit(False))


def is_type_word(word: Column, hints: Column) -> Column:
    """Whether a word names a type of device: blank, the start of a document's number, a word of a hint, or made of type words."""
    w = F.lower(F.regexp_replace(F.coalesce(word, F.lit("")), "^[ .,\"'«»-]+|[ .,\"'«»-]+$", ""))
    hinted = F.exists(hints, lambda h: F.array_contains(F.regexp_extract_all(F.lower(F.coalesce(h, F.lit(""))), F.lit("[a-zа-яё0-9]+(?:-[a-zа-яё0-9]+)*"), F.lit(0)), w))
    parts = F.filter(F.split(w, "[-–]"), lambda p: p.rlike("[a-zа-яё]"))
    known = r"(?U)^(?:" + "|".join(TYPE_WORDS + DESCRIPTIVE_WORDS) + r")"
    typed = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(known))
    return (w == "") | w.isin(*DOCUMENT_WORDS) | F.coalesce(hinted, F.lit(False)) | typed


def is_type_fragment(candidate: Column, hints: Column) -> Column:
    """Whether a candidate with a digit after a Cyrillic letter is the beginning of a word of the type's name."""
    letters = N.folded(F.regexp_replace(F.coalesce(candidate, F.lit("")), "[^A-Za-zА-ЯЁа-яё]", ""))
    longer = lambda w: (F.length(w) > F.length(letters)) & F.startswith(N.folded(w), letters)
    begins = F.exists(hints, lambda h: F.exists(N.words(h), longer))
    return F.coalesce(candidate.rlike(r"[А-ЯЁа-яё]\d") & (F.length(letters) >= 4) & begins, F.lit(False))


def is_type_abbreviation(candidate: Column, source: Column) -> Column:
    """Whether two to five capitals are the initials of words in a row of the source."""
    letters = F.regexp_replace(F.coalesce(candidate, F.lit("")), r"[\s–-]", "")
    found = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit("[А-ЯЁA-Za-zа-яё]{3,}"), F.lit(0))
    initials = F.array_join(F.transform(found, lambda w: F.upper(F.substring(w, 1, 1))), "")
    itself = F.exists(found, lambda w: F.upper(w) == letters)
    return F.coalesce(letters.rlike("^[A-ZА-ЯЁ]{2,5}$") & F.contains(initials, letters) & ~itself, F.lit(False))


def mended_script(c: Column) -> Column:
    """Each word that mixes look-alike Latin and Cyrillic letters in the script that most of its letters are of."""

    def mend(w: Column) -> Column:
        latin, cyrillic = F.regexp_count(w, F.lit("[A-Za-z]")), F.regexp_count(w, F.lit("[А-Яа-яЁё]"))
        to_cyrillic = F.translate(w, N.LOOKALIKE_LATIN, N.LOOKALIKE_CYRILLIC)
        return F.when((latin == 0) | (cyrillic == 0), w).when(cyrillic > latin, to_cyrillic).otherwise(N.latinised(w))

    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), " "), mend), " ")


def family_root(c: Column) -> Column:
    """The letters that a mark begins with, up to the first hyphen, slash or digit of its first word."""
    first = F.get(F.split(F.trim(mended_script(c)), r"\s+"), F.lit(0))
    return F.replace(N.name_key(F.regexp_extract(first, r"^[^–/\d-]*", 0)), F.lit(" "), F.lit(""))


def same_family(a: Column, b: Column) -> Column:
    """Whether the roots of two marks, of four letters at least, are equal or one begins with the other."""
    x, y = family_root(a), family_root(b)
    return (F.length(x) >= 4) & (F.length(y) >= 4) & (F.startswith(x, y) | F.startswith(y, x))


def mark_keys(mark: Column, hints: Column) -> Column:
    """What a mark may be known by: all of it, its first word if that is no type word, later words with a digit and two letters; four characters at least."""
    words = F.split(F.trim(F.coalesce(mark, F.lit(""))), r"\s+")
    several = F.size(words) > 1
    first = F.when(several & ~is_type_word(F.get(words, F.lit(0)), hints), N.mark_key(F.get(words, F.lit(0))))
    later = F.filter(F.transform(words, lambda w, i: F.when(i > 0, N.mark_key(w))), lambda k: k.rlike(r"\d") & (F.length(F.regexp_replace(k, r"\d", "")) >= 2))
    every = F.concat(F.array(N.mark_key(F.coalesce(mark, F.lit(""))), first), later)
    return F.array_distinct(F.filter(every, lambda k: k.isNotNull() & (F.length(k) >= 4)))


def extends(short: Column, long: Column) -> Column:
    """Whether a mark goes on from a shorter one, not in the middle of a word."""
    rest = F.substring(long, F.length(short) + 1, F.lit(1))
    return F.coalesce((F.length(long) > F.length(short)) & F.startswith(F.lower(long), F.lower(short)) & ~rest.rlike("[A-Za-zА-Яа-яЁё]"), F.lit(False))


def addition_listed(short: Column, long: Column, listed: Column) -> Column:
    """Whether all words that a longer mark adds are in a registry's list of variants."""
    keys = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), N.mark_key), lambda k: k != "")
    hay, added = N.mark_key(F.coalesce(listed, F.lit(""))), F.array_except(keys(long), keys(short))
    return (hay != "") & F.when(F.size(added) > 0, F.forall(added, lambda k: F.contains(hay, k))).otherwise(F.contains(hay, N.mark_key(long)))


def lists_several(name: Column) -> Column:
    """Whether a registered name is of several models: a list after the word, several quoted names, or several articles before the standard's number."""
    text = F.coalesce(name, F.lit(""))
    head = F.regexp_replace(text, STANDARD_TAIL, "")
    many = lambda pattern, group: F.size(F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(group)), lambda m: F.lower(F.trim(m))))) > 1
    return text.rlike(MODEL_LIST) | many(r"[«\"]([^«»\"]{2,40})[»\"]", 1) | many(ARTICLE, 0)


def as_written(key: Column, text: Column) -> Column:
    """The first word of a text with a key, as it is written there; without one the key in capitals."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-zА-Яа-яЁё-]+"), F.lit(0))
    return F.coalesce(F.get(F.filter(found, lambda w: N.latin_key(w) == key), F.lit(0)), F.upper(key))


def clean_trademark(c: Column) -> Column:
    """A trade mark without the remarks that forms add to it."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), TRADEMARK_BOILERPLATE, " "), TRADEMARK_ABSENT, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), "^[ .,;:—-]+|[ .,;:—-]+$", "")


def listed_articles(c: Column) -> Column:
    """Articles in brackets that differ in their numbers alone: two at least of one prefix, else none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\(\s*([A-Za-zА-ЯЁа-яё0-9][\w\-–/. ]{2,23})\s*\)"), F.lit(1)), lambda a: F.trim(a)))
    articles = F.filter(found, lambda a: a.rlike(r"\d"))
    prefixes = F.array_distinct(F.transform(articles, lambda a: F.regexp_replace(F.upper(F.regexp_extract(a, r"^[^\d]*", 0)), "[ –_-]+$", "")))
    numbers = F.array_distinct(F.transform(articles, lambda a: F.regexp_replace(a, r"\D", "")))
    return F.when((F.size(prefixes) == 1) & (F.size(numbers) >= 2), articles).otherwise(F.array().cast("array<string>"))


def brand_tokens(texts: Column, hints: Column) -> Column:
    """Words that may name a maker: strong tokens of four letters, no type words or legal forms; the first two that differ in more than case."""
    every = F.flatten(F.transform(texts, I.strong_tokens))
    good = F.filter(every, lambda w: w.rlike("^[A-Za-zА-Яа-яЁё]{4,}$") & ~is_type_word(w, hints) & ~F.lower(w).isin(*N.LEGAL_FORMS, *N.MORE_FORMS))
    return F.slice(I.first_of_case(good), 1, 2)  # each is a question to the registry


def without_company_tail(mark: Column, names: Column) -> Column:
    """A mark up to the word that begins a company's name, unless the mark itself begins so."""

    def head_word(name: Column) -> Column:
        telling = F.filter(F.regexp_extract_all(F.regexp_replace(name, r"\([^)]*\)", " "), F.lit("[A-Za-zА-Яа-яЁё]{3,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*N.LEGAL_FORMS, *N.FOREIGN_ENDINGS))
        return N.mark_key(F.get(telling, F.lit(0)))

    heads = F.filter(F.transform(names, head_word), lambda k: k.isNotNull() & (k != ""))
    words = F.split(F.coalesce(mark, F.lit("")), " ")
    places = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(heads, N.mark_key(w)), i)), lambda i: i.isNotNull())
    cut = F.array_join(F.slice(words, F.lit(1), F.coalesce(F.array_min(places), F.size(words))), " ")
    return F.when(F.size(places) > 0, F.regexp_replace(cut, "^[ –,;\"'«»-]+|[ –,;\"'«»-]+$", "")).otherwise(mark)


def _without_numerals(text: Column, known: Column | None) -> Column:
    """A mark without the Roman numbers after it, up to one that is a known variant."""
    tail = r"(?:\s+[IVX]{1,4}\.?)+$"
    if known is None:
        return F.regexp_replace(text, tail, "")
    numerals = F.filter(F.split(F.trim(F.regexp_extract(text, tail, 0)), r"\s+"), lambda n: n != "")
    held = F.transform(F.coalesce(known, F.array().cast("array<string>")), F.lower)
    last = F.array_max(F.transform(numerals, lambda n, i: F.when(F.array_contains(held, F.lower(F.replace(n, F.lit("."), F.lit("")))), i + 1)))
    return F.concat_ws(" ", F.regexp_replace(text, tail, ""), F.when(last.isNotNull(), F.array_join(F.slice(numerals, F.lit(1), last), " ")))


def _without_label(text: Column, known: Column | None = None) -> Column:
    """A mark up to what a variant's label begins, unless nothing stands before it, and without Roman numbers after it or an item number before it."""
    cut = N.let(F.regexp_replace(text, TAIL_WORDS, ""), lambda c: F.when(F.trim(c) == "", text).otherwise(F.regexp_replace(c, "[ –.,;:\"'«»-]+$", "")))
    return F.regexp_replace(_without_numerals(cut, known), r"^(?:\d{1,2}\s*[.)]\s*|[1-9]\s+)(?=[A-Za-zА-Яа-яЁё])", "")


def _said_once(words: Column) -> Column:
    """Words without a repeated half, and without a repeated word unless it is a number."""
    low, half = F.transform(words, F.lower), F.floor(F.size(words) / 2).cast("int")
    twice = (F.size(words) % 2 == 0) & (F.slice(low, F.lit(1), half) == F.slice(low, half + 1, half))
    single = lambda ws: F.filter(ws, lambda w, i: (i == 0) | w.rlike(r"^\d+$") | (F.lower(w) != F.lower(F.coalesce(F.get(ws, i - 1), F.lit("")))))
    return N.let(F.when(twice, F.slice(words, F.lit(1), half)).otherwise(words), single)


def _without_device(words: Column) -> Column:
    """A mark's words without the device words that lead it, if there still is a mark after them."""
    other = F.filter(F.transform(words, lambda w, i: F.when(~w.rlike(DEVICE_WORD), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(other, F.lit(0)), F.lit(0))
    rest = F.array_join(F.slice(words, first + 1, F.size(words)), " ")
    return N.let(rest, lambda r: F.when(I.looks_like_mark(r) & (F.length(r) <= 40), r).otherwise(F.array_join(words, " ")))


def tidy_mark(mark: Column, known: Column | None = None) -> Column:
    """A mark without an item number before it, a repeated half or word, device words that lead it, and what a variant's label begins.

    A Roman number at its end stays if it is one of the `known` variants.
    """
    text = N.let(F.trim(F.regexp_replace(F.coalesce(mark, F.lit("")), r"\s+", " ")), lambda t: _without_label(t, known))
    return N.let(N.let(F.split(text, " "), _said_once), _without_device)


def why_no_mark(mark: Column, manufacturer: Column) -> Column:
    """Why a tidied mark is none, the first reason that holds; null if it is one."""

    def reason(m: Column) -> Column:
        bare = F.regexp_replace(m, "^[ .,\"'«»]+|[ .,\"'«»]+$", "")
        company = C.is_company_name(m, F.lit("")) | F.coalesce((N.mark_key(m) != "") & (N.mark_key(m) == N.mark_key(manufacturer)), F.lit(False))
        describes = m.rlike(r"(?iU)^(?:" + "|".join(DESCRIPTIVE_WORDS) + r")\b") | m.rlike(NO_MARK)
        return (
            F.when(company, IS_COMPANY).when(bare == "", IS_NOTHING).when(describes, IS_DESCRIPTION).when(I.is_measure(m), IS_MEASURE)
            .when(bare.rlike(C.COUNTRY_WORD), IS_COUNTRY).when((_count(m, ",") >= 2) | (_count(m, "(") != _count(m, ")")), IS_LIST)
        )

    return N.let(F.coalesce(mark, F.lit("")), reason)


# --- questions and captions ---


def name_variants(c: Column) -> Column:
    """Ever shorter forms of a name to ask a catalogue for: without the last part after a comma or slash, again and again, then its first two words."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?=[,/])")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))
    words = F.filter(F.split(N.name_key(F.get(parts, F.lit(0))), " "), lambda w: F.length(w) > 2)
    every = F.transform(F.concat(heads, F.array(F.when(F.size(words) > 2, F.array_join(F.slice(words, 1, 2), " ")))), lambda q: F.regexp_replace(F.coalesce(q, F.lit("")), "^[ ,;./]+|[ ,;./]+$", ""))
    return I.first_of_case(F.filter(every, lambda q: q != ""))


def lines(c: Column) -> Column:
    """The lines and parts between semicolons of what a user typed, each once in any case."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n;]"), lambda p: F.trim(p)), lambda p: p != "")
    return I.first_of_case(parts)


def earlier(a: Column, b: Column) -> Column:
    """Whether a day is before another; false if either is none."""
    return F.coalesce(N.date(a) < N.date(b), F.lit(False))


def contract_key(number: Column, reference: Column) -> Column:
    return F.coalesce(N.blank_to_null(number), N.blank_to_null(reference))


def value_text(quality: Column, concrete: Column, low: Column, high: Column, unit: Column) -> Column:
    """A characteristic's value: words, a number, or a range, with its unit; strict limits keep their sign."""
    said = {"quality": quality, "concrete": concrete, "low": low, "high": high}
    given = F.struct(*[c.alias(n) for n, c in said.items()], F.coalesce(unit, F.lit("")).alias("unit"))
    bound = lambda v: F.struct(*[v[n] for n in ("low", "high", "unit")], *[N.blank_to_null(v[n]).alias(f"some_{n}") for n in said])

    def text(v: Column) -> Column:
        short = F.when(F.length(v["unit"]) > 1, F.lower(v["unit"])).otherwise(v["unit"])
        least, most = v["some_low"].isNotNull(), v["some_high"].isNotNull()
        spread = F.when(least & most, F.concat(v["low"], F.lit("–"), v["high"])).when(least, F.concat(F.lit("от "), v["low"])).when(most, F.concat(F.lit("до "), v["high"]))
        return F.coalesce(v["some_quality"], F.trim(F.concat(F.coalesce(v["some_concrete"], spread), F.lit(" "), short)), F.lit(""))

    return N.let(given, lambda v: N.let(bound(v), text))


def duration(seconds: Column) -> Column:
    """About how long, as one would say it."""
    minutes = F.rint(seconds / 60).cast("int")
    hours, rest = F.floor(minutes / 60).cast("int"), minutes % 60
    whole = F.when(hours == 1, "около часа").otherwise(F.concat(F.lit("около "), hours.cast("string"), F.lit(" "), N.plural(hours, "часа", "часов", "часов")))
    some = F.concat(F.lit("около "), minutes.cast("string"), F.lit(" "), N.plural(minutes, "минуты", "минут", "минут"))
    return F.when(seconds < 45, "меньше минуты").when(minutes <= 1, "около минуты").when(minutes < 60, some).when(rest < 10, whole).otherwise(F.concat(whole, F.lit(" "), rest.cast("string"), F.lit(" мин")))


def report_name(code: Column, at: Column) -> Column:
    """A file name for a report: what was asked for first, and when."""
    tag = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(code, F.lit("")), F.lit("."), F.lit("_")), "[^0-9A-Za-zА-Яа-яЁё_-]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("медизделия_"), F.when(tag == "", "папка").otherwise(F.left(tag, F.lit(60))), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))
