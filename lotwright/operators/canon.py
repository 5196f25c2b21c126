"""Canonical spellings of producers and marks, and groups that users maintain."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import LEGAL_FORMS, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN, MORE_FORMS
from .ranking import most_common

# --- groups that users maintain: pure functions of a mapping title -> spellings ---

_FORMS = {*LEGAL_FORMS, *MORE_FORMS}
_TWINS = str.maketrans(LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN)


def plain_key(name: str) -> str:
    """The group key of one name, as functions.normalise.group_key has it for columns."""
    words = re.findall(r"[a-zа-я0-9]+", (name or "").lower().replace("ё", "е"))
    return "".join(w for w in words if w not in _FORMS).translate(_TWINS)


def merge_groups(groups: dict[str, list[str]], names: list[str], title: str = "") -> dict[str, list[str]]:
    """Put names, and every group that shares a key with one of them, into one group."""
    title = title.strip() or (names[0].strip() if names else "")
    if not title:
        return groups
    wanted, members, left = {plain_key(n) for n in [*names, title]}, list(names), {}
    for held, spellings in groups.items():
        if wanted & {plain_key(s) for s in [held, *spellings]}:
            members += [held, *spellings]
        else:
            left[held] = spellings
    by_key: dict[str, str] = {}
    for m in members:
        by_key.setdefault(plain_key(m), m)
    return left | {title: sorted(by_key.values(), key=str.lower)}


def split_groups(groups: dict[str, list[str]], names: list[str]) -> dict[str, list[str]]:
    """Take names out of their groups; a group whose title goes, or that has one member left, is no more."""
    gone, out = {plain_key(n) for n in names}, {}
    for title, spellings in groups.items():
        left = [s for s in spellings if plain_key(s) not in gone]
        if len(left) > 1 and plain_key(title) not in gone:
            out[title] = left
    return out


def rename_group(groups: dict[str, list[str]], title: str, new: str) -> dict[str, list[str]]:
    """A group under another title; nothing changes if the new one is blank or the old one is none."""
    new = new.strip()
    if not new or new == title or title not in groups:
        return groups
    return {k: v for k, v in groups.items() if k not in (title, new)} | {new: groups[title]}


def group_table(spark, groups: dict[str, list[str]]) -> DataFrame:
    """(key, manual): the group that each key was put in by hand, the last if there are several."""
    pairs = {plain_key(s): title for title, spellings in groups.items() for s in [title, *spellings]}
    return spark.createDataFrame(list(pairs.items()), "key string, manual string")


# --- tables of spellings ---


def assign_groups(spellings: DataFrame, name: str, key: Column, manual: DataFrame | None = None) -> DataFrame:
    """(name, title): the group put by hand, or else the commonest, then shortest, then first spelling of the key.

    `spellings` has a row for each use of a name.
    """
    counted = spellings.groupBy(name).agg(F.count("*").alias("n")).withColumn("key", key)
    auto = counted.groupBy("key").agg(F.max_by(name, F.struct(F.col("n"), -F.length(name), F.hex(name))).alias("auto"))
    joined = counted.join(auto, "key")
    if manual is None:
        return joined.select(name, F.col("auto").alias("title"))
    return joined.join(manual, "key", "left").select(name, F.coalesce("manual", "auto").alias("title"))


def merge_companies(names: DataFrame, name: str, core: Column, form: Column, position: str) -> DataFrame:
    """(core, form, title): spellings by core and legal form; those without a form join the largest form of their core."""
    keyed = names.withColumn("core", core).withColumn("form", form)
    sizes = keyed.groupBy("core", "form").agg(F.count("*").alias("n"))
    largest = sizes.filter("form <> ''").groupBy("core").agg(F.max_by("form", F.struct("n", "form")).alias("largest"))
    joined = keyed.join(largest, "core", "left").withColumn("form", F.when(F.col("form") == "", F.coalesce("largest", F.lit(""))).otherwise(F.col("form")))
    return most_common(joined, ["core", "form"], name, position).withColumnRenamed(name, "title")


def canonical_case(tokens: DataFrame, token: str) -> DataFrame:
    """(key, spelling): of spellings that differ in case alone the commonest, then that with fewest capitals, then the smallest."""
    counted = tokens.groupBy(token).agg(F.count("*").alias("n")).withColumn("key", F.lower(token))
    capitals = F.length(F.regexp_replace(token, "[^A-ZА-ЯЁ]", ""))
    ranked = counted.withColumn("caps", capitals)
    least = ranked.groupBy("key").agg(F.min_by(F.struct(F.col(token), F.col("n")), F.struct(-F.col("n"), F.col("caps"), F.col(token))).alias("b"), F.count("*").alias("spellings"))
    return least.select("key", F.col(f"b.{token}").alias("spelling"), F.col("b.n").alias("n"), "spellings")
