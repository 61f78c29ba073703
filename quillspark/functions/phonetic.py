"""Readings of Han text: a table of readings drives everything, so any pronunciation source can be plugged in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Initials, and which sounds are confused with which.
INITIALS = ("b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "zh", "ch", "sh", "r", "z", "c", "s", "y", "w")
CONFUSED_INITIALS = (("s", "sh"), ("c", "ch"), ("z", "zh"), ("l", "n"))
CONFUSED_FINALS = (("in", "ing"), ("en", "eng"), ("ong", "on"), ("an", "ang"))
CONFUSED_SYLLABLES = (("xuan", "xian"), ("qian", "quan"), ("xu", "xi"), ("qu", "qi"), ("yu", "yi"), ("ju", "ji"), ("me", "mo"), ("nv", "lv"), ("nan", "lan"), ("hu", "fu"))
CONFUSED_ONE_WAY = (("yong", "you"),)

_INITIAL = "^(" + "|".join(sorted(INITIALS, key=len, reverse=True)) + ")?(.*)$"


def both_ways(pairs: tuple) -> dict[str, str]:
    return {a: b for x, y in pairs for a, b in ((x, y), (y, x))}


def _lookup(table: dict[str, str], key: Column) -> Column:
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def initial(syllable: Column) -> Column:
    """'' for syllables of one letter, which are all final."""
    return F.when(F.length(syllable) == 1, F.lit("")).otherwise(F.regexp_extract(syllable, _INITIAL, 1))


def final(syllable: Column) -> Column:
    return F.when(F.length(syllable) == 1, syllable).otherwise(F.regexp_extract(syllable, _INITIAL, 2))


def toneless(syllable: Column) -> Column:
    return F.regexp_replace(syllable, "[0-9]", "")


def same_initial_or_final(a: Column, b: Column) -> Column:
    """0: neither, 1: initials, 2: finals, 3: both are the same."""
    return F.when(initial(a) == initial(b), 1).otherwise(0) + F.when(final(a) == final(b), 2).otherwise(0)


def similar_reading(a: Column, b: Column) -> Column:
    """Readings at most one letter apart."""
    return F.levenshtein(a, b) <= 1


def confusable(syllable: Column) -> Column:
    """The readings that a syllable is confused with: by its initial, its final, or as a whole; one of them is changed at a time."""
    i, f = initial(syllable), final(syllable)
    by_initial = F.concat(_lookup(both_ways(CONFUSED_INITIALS), i), f)
    by_final = F.concat(i, _lookup(both_ways(CONFUSED_FINALS), f))
    whole = _lookup(both_ways(CONFUSED_SYLLABLES) | dict(CONFUSED_ONE_WAY), syllable)
    return F.array_distinct(F.array_compact(F.array(by_initial, by_final, whole)))


def confusable_words(syllables: Column) -> Column:
    """Readings of a word, as arrays, with one syllable changed to one that it is confused with."""

    def at(s: Column, i: Column) -> Column:
        return F.transform(confusable(s), lambda x: F.concat(F.slice(syllables, F.lit(1), i), F.array(x), F.slice(syllables, i + 2, F.size(syllables))))

    return F.flatten(F.transform(syllables, at))


def reading(word: Column, readings: Column) -> Column:
    """The word's syllables by a map of characters to readings; characters without one stand for themselves."""
    return F.transform(F.split(word, ""), lambda c: F.coalesce(F.try_element_at(readings, c), c))


def same_reading(a: Column, b: Column, readings: Column) -> Column:
    """Equal readings without tones, all characters together."""
    return F.array_join(F.transform(reading(a, readings), toneless), "") == F.array_join(F.transform(reading(b, readings), toneless), "")


def different_tone(a: Column, b: Column) -> Column:
    """Some toned syllable of arrays a and b differs."""
    return F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)


def pronunciation_type(a: Column, b: Column, other_readings: Column) -> Column:
    """0: the same, 1: the same without tones or by another reading of a, 2: one letter apart, 3: different. other_readings: array of a's."""
    return F.when(a == b, 0).when((toneless(a) == toneless(b)) | F.array_contains(other_readings, b), 1).when(similar_reading(toneless(a), toneless(b)), 2).otherwise(3)


def words_similar(a: Column, b: Column) -> Column:
    """Arrays of one length whose syllables are each the same or one letter apart."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, similar_reading), lambda x: x)


def homophones(readings: DataFrame) -> DataFrame:
    """(char, homophone) of a table (char, reading): an equi-join on the toneless reading."""
    key = readings.select(F.col("char"), toneless(F.col("reading")).alias("key")).distinct()
    return key.join(key.withColumnRenamed("char", "homophone"), "key").filter("char <> homophone").select("char", "homophone").distinct()
