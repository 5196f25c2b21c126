"""Column functions for prices against the starting price of a purchase."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import plural

# Notes, and the parts of a way of placing that tell there was no bidding.
NO_BIDDING = "торгов не было"
NO_START = "начальная цена не найдена"
SMALL_VOLUME = "торгов не было: закупка малого объёма"
AMENDED = "цена изменена доп. соглашением"
ABOVE_START = "цена контракта выше начальной — сравнивать не с чем"
NO_BIDDING_WAYS = "единственн|без проведения"
SMALL_VOLUME_WAYS = r"малого объ|статьи 93|ст\. 93|ст\.93|электронный магазин|портал поставщиков"
FINE = "—"


def raw_percent(start: Column, price: Column) -> Column:
    """How far the price is below the starting price, in percent; null where either is unknown or the start is 0."""
    return F.when(start != 0, F.round(100 * (start - price) / start, 2))


def incomparable(amended: Column, note: Column, start: Column, price: Column) -> Column:
    """Why the price can't be compared; empty if it can."""
    return F.when(amended, AMENDED).when(F.coalesce(note, F.lit("")) != "", note).when(price > start, ABOVE_START).otherwise("")


def no_bidding_note(way: Column, amended: Column, note: Column, start: Column, price: Column, *, none: str = NO_BIDDING_WAYS, small: str = SMALL_VOLUME_WAYS) -> Column:
    """Why there is no reduction to speak of; a dash if there is."""
    way, why = F.lower(F.coalesce(way, F.lit(""))), incomparable(amended, note, start, price)
    return (
        F.when(way.rlike(none), NO_BIDDING)
        .when(why != "", why)
        .when(start.isNull(), NO_START)
        .when((raw_percent(start, price) == 0) & way.rlike(small), SMALL_VOLUME)
        .otherwise(FINE)
    )


def discount_percent(bidding: Column, start: Column, price: Column) -> Column:
    return F.when(bidding == FINE, raw_percent(start, price))


def discount(bidding: Column, start: Column, price: Column) -> Column:
    return F.when(bidding == FINE, F.round(start - price, 2))


def short_percent(c: Column) -> Column:
    """One digit after the point, two for less than a tenth."""
    return F.when(F.abs(c) >= 0.1, F.round(c, 1)).otherwise(F.round(c, 2))


def discount_note(lowered: Column, known: Column, no_bidding: Column, incomparable: Column, most: Column) -> Column:
    """One line on the price reductions of some contracts: how many and how far, how many without bidding, how many beyond comparison."""
    many = lambda n: plural(n, "контракт", "контракта", "контрактов")
    of = lambda n: F.when((n % 10 == 1) & (n % 100 != 11), "контракта").otherwise("контрактов")
    text = lambda c: c.cast("string")
    percent = short_percent(most)
    # a whole number is written with one digit after the point, as any other
    furthest = F.when(percent != 0, F.concat(F.lit(", максимум −"), text(percent), F.lit("%"))).otherwise("")
    head = (
        F.when((known == 0) & (no_bidding > 0), NO_BIDDING)
        .when(known == 0, "начальная цена неизвестна")
        .when((lowered == 0) & (known == 1), "контракт заключён по начальной цене")
        .when(lowered == 0, F.concat(F.lit("все "), text(known), F.lit(" "), many(known), F.lit(" — по начальной цене")))
        .otherwise(F.concat(F.lit("снижали в "), text(lowered), F.lit(" из "), text(known), F.lit(" "), of(known), F.coalesce(furthest, F.lit(""))))
    )
    without = F.when((no_bidding > 0) & (known > 0), F.concat(F.lit("ещё "), text(no_bidding), F.lit(" без торгов")))
    beyond = F.when(incomparable > 0, F.concat(F.lit("у "), text(incomparable), F.lit(" "), of(incomparable), F.lit(" цену сравнить не с чем")))
    return F.concat_ws("; ", head, without, beyond)
