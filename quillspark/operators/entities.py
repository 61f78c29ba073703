"""Names and other entities of a document: counts, spellings that disagree, pronouns that disagree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lookups import first_by, merged
from quillspark.sources.lexicons import small

# Classes of entities.
PERSON, PLACE, ORGANISATION, VIDEO, WORK = 0, 1, 2, 3, 4
# Codes of a lexicon of genders; 3 and 4 are words that imply one.
HE, SHE, IMPLIES_HE, IMPLIES_SHE = 1, 2, 3, 4
PRONOUNS = {HE: "他", SHE: "她"}


def counts(entities: DataFrame) -> DataFrame:
    """doc_id, cls, word, n, first: how often a document has an entity, and where first. entities: doc_id, cls, word, pos."""
    return entities.filter(F.col("cls") < WORK).groupBy("doc_id", "cls", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def document_entities(counted: DataFrame) -> DataFrame:
    """doc_id with a map of counts and an array of names for each class, and all names together."""
    out = counted.groupBy("doc_id").agg(
        *[F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("cls") == c, F.struct("word", "n"))))).alias(f"count_{c}") for c in (PERSON, PLACE, ORGANISATION, VIDEO)],
        F.sort_array(F.collect_set("word")).alias("all_names"),
    )
    return out


def majority(counted: DataFrame, reading: str, listed: DataFrame | None = None) -> DataFrame:
    """doc_id, reading, winner of readings that a document spells in two ways or more.

    The most frequent spelling wins, ties to the one first seen last; spellings in `listed` (name) go before all others.
    counted: doc_id, word, n, first and a reading.
    """
    rows = counted
    if listed is not None:
        mark = small(listed.select(F.col("name").alias("_name")).distinct().withColumn("_listed", F.lit(True)))
        rows = rows.join(mark, rows["word"] == mark["_name"], "left").withColumn("_in", F.coalesce("_listed", F.lit(False)))
    else:
        rows = rows.withColumn("_in", F.lit(False))
    return rows.groupBy("doc_id", reading).agg(F.max_by("word", F.struct("_in", "n", "first")).alias("winner"), F.count_distinct("word").alias("k")).filter("k > 1").drop("k")


def name_errors(counted: DataFrame, reading: str, wrong: DataFrame, casts: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, word, rule, right for persons: a list of wrong names first, then the cast of a video that the document names, then the majority spelling.

    counted: doc_id, cls, word, n, first, reading. wrong: key, value. casts: title, py, name, rank. listed: name.
    """
    persons = counted.filter(F.col("cls") == PERSON)
    by_list = persons.join(small(wrong), persons["word"] == wrong["key"]).filter("word <> value").select("doc_id", "word", F.lit("7_baidu").alias("rule"), F.col("value").alias("right"))
    videos = counted.filter(F.col("cls") == VIDEO).select("doc_id", F.col("word").alias("title"), F.col("first").alias("seen"))
    named = videos.join(small(casts), "title").select("doc_id", F.col("py").alias(reading), "name", "seen", "title", "rank")
    # the first title that has a reading decides which names it may be
    title = named.groupBy("doc_id", reading).agg(F.min(F.struct("seen", "title")).alias("t"))
    cast = named.join(title, ["doc_id", reading]).filter("title = t.title").groupBy("doc_id", reading).agg(F.collect_set("name").alias("names"), F.min_by("name", "rank").alias("right"))
    in_cast = persons.join(cast, ["doc_id", reading])
    by_cast = in_cast.filter(~F.array_contains("names", F.col("word"))).select("doc_id", "word", F.lit("7_vdo").alias("rule"), "right")
    rest = persons.join(cast.select("doc_id", reading), ["doc_id", reading], "left_anti")
    by_count = rest.join(majority(persons, reading, listed), ["doc_id", reading]).filter("word <> winner").select("doc_id", "word", F.lit("7_freq").alias("rule"), F.col("winner").alias("right"))
    ranked = by_list.withColumn("p", F.lit(0)).unionByName(by_cast.withColumn("p", F.lit(1))).unionByName(by_count.withColumn("p", F.lit(2)))
    return first_by(ranked, ["doc_id", "word"], ["p"]).drop("p")


def other_errors(counted: DataFrame, reading: str, titles: DataFrame, wrong_places: DataFrame) -> DataFrame:
    """doc_id, word, rule, right for video titles of four characters or more with a listed title's reading, and for listed wrong places."""
    video = counted.filter((F.col("cls") == VIDEO) & (F.length("word") >= 4))
    known = titles.groupBy(F.col("py").alias(reading)).agg(F.collect_set("name").alias("names"), F.min_by("name", "rank").alias("right"))
    by_title = video.join(small(known), reading).filter(~F.array_contains("names", F.col("word"))).select("doc_id", "word", F.lit("9_vdo").alias("rule"), "right")
    place = counted.filter(F.col("cls") == PLACE)
    by_place = place.join(small(wrong_places), place["word"] == wrong_places["key"]).filter("word <> value").select("doc_id", "word", F.lit("9_loc_baidu").alias("rule"), F.col("value").alias("right"))
    return by_title.unionByName(by_place.join(by_title, ["doc_id", "word"], "left_anti"))


def all_errors(persons: DataFrame, others: DataFrame) -> DataFrame:
    """Both together; what persons say wins."""
    pair = lambda d: d.select(F.struct("doc_id", "word").alias("k"), F.struct("rule", "right").alias("v"))
    return merged(pair(persons), pair(others), "k", "v").select("k.doc_id", "k.word", "v.rule", "v.right")


def conflicts(gender: Column, men: Column, women: Column) -> Column:
    """A sentence of this gender has words that imply the other."""
    return ((gender == HE) & (women > 0)) | ((gender == SHE) & (men > 0))


def carried(sentences: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "sno") -> DataFrame:
    """Which sentences use a pronoun against the gender that they or the sentence before establish.

    sentences: names (distinct persons), gendered (those of known gender), gender (of the first of them), men, women (words
    that imply one), he, she (pronouns). Columns added: sentence_gender, fires. What a sentence hands on depends on itself
    only, so the state is one lag.
    """
    ambiguous = (F.col("gendered") > 1) | (F.col("names") > 1) | ((F.col("men") > 0) & (F.col("women") > 0))
    one_kind = (F.col("he") == 0) | (F.col("she") == 0)
    own = F.when(F.col("gendered") == 1, F.col("gender"))
    hands_on = F.when(own.isNotNull() & ~ambiguous & (one_kind | ~conflicts(own, F.col("men"), F.col("women"))), own)
    w = Window.partitionBy(*keys).orderBy(order)
    out = sentences.withColumn("_carry", hands_on).withColumn("sentence_gender", F.coalesce(own, F.lag("_carry").over(w)))
    g = F.col("sentence_gender")
    return out.withColumn("fires", F.coalesce(~ambiguous & g.isin(HE, SHE) & ~one_kind & ~conflicts(g, F.col("men"), F.col("women")), F.lit(False))).drop("_carry")


def gender_counts(words: DataFrame, genders: DataFrame) -> DataFrame:
    """The input of carried(): one row a sentence. words: doc_id, sno, idx, word, flag (-2: person); genders: key, value (code)."""
    g = genders.select(F.col("key").alias("word"), F.col("value").cast("int").alias("code"))
    w = words.join(small(g), "word", "left").withColumn("person", F.col("flag") == -2)
    implied = ~F.col("person") & (F.length("word") == 2)
    person = F.when(F.col("person"), F.col("word"))
    known = F.when(F.col("person") & F.col("code").isNotNull(), F.col("word"))
    return w.groupBy("doc_id", "sno").agg(
        F.count_distinct(person).alias("names"), F.count_distinct(known).alias("gendered"), F.min_by(F.when(F.col("person"), F.col("code")), F.when(known.isNotNull(), F.col("idx"))).alias("gender"),
        F.count_if(implied & (F.col("code") == IMPLIES_HE)).alias("men"), F.count_if(implied & (F.col("code") == IMPLIES_SHE)).alias("women"),
        F.count_if(F.col("word") == PRONOUNS[HE]).alias("he"), F.count_if(F.col("word") == PRONOUNS[SHE]).alias("she"),
    )


def pronoun_errors(words: DataFrame, genders: DataFrame) -> DataFrame:
    """Errors of type 23: pronouns of the other gender in sentences that fire. words also have para, char_off and sentence."""
    fired = carried(gender_counts(words, genders)).filter("fires").select("doc_id", "sno", "sentence_gender")
    right = F.when(F.col("sentence_gender") == HE, PRONOUNS[HE]).otherwise(PRONOUNS[SHE])
    rows = words.join(fired, ["doc_id", "sno"]).withColumn("right", right).filter(F.col("word").isin(*PRONOUNS.values()) & (F.col("word") != F.col("right")))
    return rows.select("doc_id", "sno", F.col("char_off").alias("char_pos"), F.col("sentence").alias("clause"), F.col("word").alias("wrong"), "right", F.lit(23).alias("type"), F.lit(1.0).alias("prob"), F.col("sentence").alias("sentence"), F.when(F.col("para") <= 1, 2).otherwise(1).alias("term_imp"), F.lit(0).alias("recall"), (F.col("char_off") - 1_000_000).alias("seq"))
