"""Candidate marks within a name: spans of telling words, joined, scored and put in order.

A span is a quotation, or words that look like parts of a designation with nothing but
spaces and hyphens between them. Spans never overlap, as a quotation and a run of words
are found from left to right in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import identifiers as I
from . import marks as M
from . import normalise as N
from .evidence import SPECIFICATION_ANY

# Words that are no mark, and those of them that are units.
NO_MARK_WORDS = (
    "ту", "ру", "гост", "исо", "iso", "мм", "см", "шт", "кг", "мл", "тип", "серия", "модель", "вариант", "исполнение", "ерул", "рзн", "фсз", "фср", "пр", "др", "т", "г", "в", "с", "по", "и",
    "фирма", "компания", "завод", "предприятие", "производитель", "изготовитель", "концерн", "корпорация", "холдинг",
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx",
)
# What a part of a designation looks like: joined by hyphens or slashes, Latin, capitals, with a digit, a capitalised word, capitals within, initials.
ITEMS = (
    r"(?=[A-Za-zА-ЯЁа-яё0-9\-–./]*[A-ZА-ЯЁ0-9])[A-Za-zА-ЯЁа-яё0-9]+(?:[-–/][A-Za-zА-ЯЁа-яё0-9]+(?:\.\d+)*)+\b",
    r"[А-ЯЁA-Z][а-яёA-Za-z]*[-–][А-ЯЁA-Z0-9][\w\-]*\b", r"[A-Za-zА-ЯЁа-яё]*\d[\w\-]*\b", r"[А-ЯЁA-Z][а-яёa-z]+[А-ЯЁA-Z][а-яёA-Za-z]*\b",
    r"[A-Za-z][A-Za-z&+.]+\b", r"[А-ЯЁ]{2,}\b", r"[А-ЯЁ][а-яё]{3,}\b", r"[А-ЯЁA-Z]\.\s*(?=[А-ЯЁA-Z])", r"[А-ЯЁA-Z](?=\s\d)",
)
QUOTED = r"[«\"']([^«»\"']{2,40})[»\"']"
#: A quotation that a hyphen joins to the word before it.
GLUED = r"(?U)(\w[\w./]*(?:-[\w./]+)*)-[«\"'](\w[\w-]{1,19})[»\"']+"
EDGE = "^[ ,;:.–—\"'«»-]+|[ ,;:.–—\"'«»-]+$"

_END = r"(?![\w\-–/])"
_SKIP = rf"(?!(?iu:{'|'.join(NO_MARK_WORDS)})\.?{_END})(?!(?iu:{'|'.join(M.DESCRIPTIVE_WORDS)}){_END})"
_ITEM = rf"\b{_SKIP}(?:{'|'.join(ITEMS)})"
SPAN = rf"(?U){QUOTED}|{_ITEM}(?:[\s\-–]*{_ITEM})*"


def unglued(text: Column) -> Column:
    """A text with typographic quotes made plain and quotations that a hyphen joins to a word made part of it."""
    plain = F.translate(F.coalesce(text, F.lit("")), "“”„‟‘’‚", "\"\"\"\"'''")
    return F.regexp_replace(plain, GLUED, "$1-$2")


def quoted_marks(text: Column) -> Column:
    """What stands in quotes, without standards' numbers; each once, no stop words."""
    found = F.transform(I.every(text, QUOTED, 1), lambda q: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(q, SPECIFICATION_ANY, " "), r"\s+", " ")), EDGE, ""))
    return F.array_distinct(F.filter(found, lambda q: (F.length(q) >= 2) & ~F.lower(q).isin(*NO_MARK_WORDS)))


def score(span: Column, quoted: Column) -> Column:
    """How much a span looks like a mark: quoted above all, Latin letters and digits above capitals, plain lower case least."""
    low = N.folded(span)
    hit = F.exists(quoted, lambda q: F.startswith(low, N.folded(q)) | F.startswith(N.folded(q), low))
    points = ((hit, 10), (span.rlike("[A-Za-z]"), 3), (span.rlike(r"\d"), 3), (span.rlike(r"(?U)\b[А-ЯЁ]{2,}\b"), 2), (span.rlike("^[А-ЯЁA-Z]"), 1), (span.rlike(r"^[а-яё\s\-–]+$"), -5))
    total = F.lit(0)
    for holds, value in points:
        total = total + F.when(holds, value).otherwise(0)
    return total


def candidates(text: Column) -> Column:
    """Spans of a name as structs (mark, score), the best first, of equals the longer, then the earlier; each once."""
    plain = unglued(M.mended_script(text))

    def ranked(s: Column) -> Column:
        found = F.transform(s["spans"], lambda x: F.regexp_replace(x, EDGE, ""))
        each = F.transform(found, lambda m, i: F.struct((-score(m, s["quoted"])).alias("worse"), (-F.length(m)).alias("shorter"), i.alias("at"), m.alias("mark")))
        order = F.array_sort(F.filter(each, lambda e: e["mark"] != ""))
        once = N.let(order, lambda es: F.filter(es, lambda e, i: F.array_position(F.transform(es, lambda x: x["mark"]), e["mark"]) == i + 1))
        return F.transform(once, lambda e: F.struct(e["mark"].alias("mark"), (-e["worse"]).alias("score")))

    return N.let(N.let(plain, lambda p: F.struct(I.every(p, SPAN).alias("spans"), quoted_marks(p).alias("quoted"))), ranked)
