"""From clause errors to results: characters, the merge with a sequence labeller, levels, and a document's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.lookups import first_by
from quillspark.sources.lexicons import small

# By error type, the chance from which an article's error is precise, and from which its document is delayed.
PRECISE = {0: 0.0, 1: 0.65, 51: 0.8, 52: 1.0, 2: 0.85, 3: 0.9, 4: 0.9, 7: 0.0, 57: 0.0, 9: 0.0, 10: 0.5, 11: 0.7, 12: 0.5, 17: 1.0, 23: 1.0}
PRECISE_ELSE = 1.0
DELAY = {0: 0.0, 1: 0.7, 5: 0.4, 6: 0.45, 51: 0.5, 52: 0.5, 2: 0.6, 3: 0.5, 4: 0.5, 7: 0.0, 57: 0.0, 9: 0.0, 10: 0.2, 11: 0.5, 12: 0.5, 17: 0.5, 23: 0.5, 20: 0.9}
DELAY_ELSE = 0.2
# Types that are kept whatever a labeller says, that repetition doesn't remove, and that always matter.
ALWAYS_KEPT = (0, 7, 57, 9, 10, 15, 17)
REPEATABLE = (0, 7, 9, 10, 15, 57)
IMPORTANT = (7, 9, 0, 17, 10, 57)
SWAPS = ("的", "得", "地")
MANY_DETAILS = 3
TITLE_SCORE, BODY_SCORE, VERDICT_SCORE = 3, 1, 3
ERROR = ("doc_id", "sno", "char_pos", "clause", "wrong", "right", "type", "prob", "sentence", "term_imp", "recall", "seq")


def threshold_table(spark, precise: dict = PRECISE, delay: dict = DELAY) -> DataFrame:
    """type, precise, delay: the thresholds as a small dimension table; nulls where a type has the default."""
    types = sorted(set(precise) | set(delay))
    return spark.createDataFrame([(t, precise.get(t), delay.get(t)) for t in types], "type int, precise double, delay double")


def importance(kind: Column, wrong: Column, right: Column, para: Column, same_reading: Column, unimportant: Column) -> Column:
    """2 important, 1 normal, 0 unimportant. unimportant: whether the right text is in the lexicon of words that don't matter."""
    both = (F.length(wrong) == 2) & (F.length(right) == 2) & (F.substring(wrong, 1, 1) != F.substring(right, 1, 1)) & (F.substring(wrong, 2, 1) != F.substring(right, 2, 1))
    return F.when(kind.isin(*IMPORTANT) | (para <= 1) | ~same_reading | both, 2).when(unimportant, 0).otherwise(1)


def characters(errors: DataFrame) -> DataFrame:
    """One row per differing character of clause errors (doc_id, sno, clause, wrong, right, char_pos, type, prob, term_imp, sentence, repeats, seq).

    seq is the order in which a sentence's errors were found; that of characters follows it. repeats: how often the document names the wrong entity; twice or more makes it a recall error. Fixed collocations don't
    report 的 and 地.
    """
    pairs = F.arrays_zip(F.split("wrong", "").alias("w"), F.split("right", "").alias("r"))
    rows = errors.select("*", F.posexplode(pairs).alias("_i", "_p")).withColumns({"_w": F.col("_p.w"), "_r": F.col("_p.r")}).filter("_w <> _r and not (type = 10 and _w in ('的', '地'))")
    recall = F.when(F.col("type").isin(7, 57, 9) & (F.coalesce("repeats", F.lit(0)) >= 2), 1).otherwise(0)
    return rows.select("doc_id", "sno", (F.col("char_pos") + F.col("_i")).alias("char_pos"), "clause", F.col("_w").alias("wrong"), F.col("_r").alias("right"), "type", "prob", "sentence", "term_imp", recall.alias("recall"), (F.col("seq") * 100 + F.col("_i")).alias("seq"))


def kept_anyway(kind: Column, prob: Column, wrong: Column, right: Column, sno: Column) -> Column:
    """Errors that stay when the labeller doesn't confirm them; titles keep more."""
    title = (wrong.isin(*SWAPS) & right.isin(*SWAPS)) | ((kind == 1) & (prob > 0.5)) | ((kind == 51) & (prob > 0.8)) | (kind.isin(2, 3, 4) & (prob > 0.8))
    return kind.isin(*ALWAYS_KEPT) | ((sno == 0) & title)


def to_label(sentences: DataFrame, errors: DataFrame, judged: DataFrame) -> DataFrame:
    """Sentences that the labeller is still to read: titles, and without errors the first two of the body, unless it was asked before. Documents with the id '0' have none."""
    e, j = errors.select("doc_id", "sno").distinct().withColumn("_e", F.lit(True)), judged.select("doc_id", "sno").distinct()
    out = sentences.filter((F.col("sno") < 3) & (F.col("doc_id") != "0")).join(e, ["doc_id", "sno"], "left").filter((F.col("sno") == 0) | F.col("_e").isNull()).drop("_e")
    return out.join(j, ["doc_id", "sno"], "left_anti")


def with_labels(errors: DataFrame, labels: DataFrame, pass_chars: list[str] = (), pass_words: list[str] = ()) -> DataFrame:
    """Errors of sentences after the labeller's say.

    errors: ERROR columns, one row a character; of a place's errors the first found counts. labels: doc_id, sno, char_pos, char, word, prob, protected, sentence, clause,
    correction: its hits in sentences that it finds wrong. Of such sentences stay the errors that are kept anyway and the hits
    that are not protected, not exempt, Han, and not of a character kept already: with the error found at that place, or as
    type 20 with the correction. If nothing is left the first error stays. Other sentences keep their errors.
    """
    at = ["doc_id", "sno"]
    wrong = labels.select(*at).distinct().withColumn("_wrong", F.lit(True))
    e = errors.join(wrong, at, "left").withColumn("_keep", kept_anyway(F.col("type"), F.col("prob"), F.col("wrong"), F.col("right"), F.col("sno")))
    calm = e.filter("_wrong is null").select(*ERROR)
    judged = e.filter("_wrong")
    kept = judged.filter("_keep")
    passed = F.col("char").isin(*pass_chars) if pass_chars else F.lit(False)
    word = F.col("word").isin(*pass_words) if pass_words else F.lit(False)
    hits = labels.filter(~F.col("protected") & T.is_han(F.col("char")) & ~passed & ~word & ~((F.length("word") > 1) & F.regexp("word", F.lit("[哥姐氏妃]$|^小"))))
    hits = hits.join(kept.select(*at, F.col("wrong").alias("char")).distinct(), [*at, "char"], "left_anti")
    first = first_by(judged, [*at, "char_pos"], ["seq"]).select(*ERROR)
    there = hits.select(*at, "char_pos", "char").join(first, [*at, "char_pos"])
    confirmed = there.filter("char = wrong").select(*ERROR)
    fresh = hits.join(first.select(*at, "char_pos"), [*at, "char_pos"], "left_anti")
    imp = F.col("term_imp") if "term_imp" in labels.columns else F.lit(2)  # 'X' has no reading, and what sounds otherwise matters
    fresh = fresh.select("doc_id", "sno", "char_pos", F.coalesce("clause", "sentence").alias("clause"), F.col("char").alias("wrong"), F.coalesce("correction", F.lit("X")).alias("right"), F.lit(20).alias("type"), "prob", "sentence", imp.alias("term_imp"), F.lit(1).alias("recall"), (F.col("char_pos") + 1_000_000).alias("seq"))
    after = kept.select(*ERROR).unionByName(confirmed).unionByName(fresh)
    empty = judged.join(after.select(*at).distinct(), at, "left_anti")
    rescued = first_by(empty, at, ["seq"]).select(*ERROR)
    return calm.unionByName(after).unionByName(rescued)


def video_recall(kind: Column, prob: Column, recall: Column) -> Column:
    """Of short videos: 2 precise, 3 delayed, else the incoming mark."""
    precise = ((kind == 0) & (prob > 0.001)) | ((kind == 1) & (prob > 0.75)) | ((kind == 2) & (prob > 0.85)) | (kind.isin(10, 12) & (prob > 0.5))
    delayed = kind.isin(0, 51) | ((kind == 1) & (prob > 0.7)) | ((kind == 2) & (prob > 0.68)) | (kind.isin(3, 4) & (prob > 0.7))
    return F.when(precise, 2).when(delayed, 3).otherwise(recall)


def frequent_dropped(errors: DataFrame, most: int = 2) -> DataFrame:
    """Errors without wrong texts that the document repeats more than `most` times; of repeatable types they become recall errors."""
    n = F.count("*").over(Window.partitionBy("doc_id", "wrong"))
    out = errors.withColumn("_n", n).filter((F.col("_n") <= most) | F.col("type").isin(*REPEATABLE))
    return out.withColumn("recall", F.when(F.col("_n") > most, 1).otherwise(F.col("recall"))).drop("_n")


def levelled(errors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """errors (with data_type) with level, 1 recall or 2 precise, and pop, whether it delays its document."""
    t = small(thresholds.withColumnRenamed("type", "_t"))
    e = errors.join(t, errors["type"] == t["_t"], "left")
    article, video = F.col("data_type") == 0, F.col("data_type") == 1
    low = (F.col("prob") < F.coalesce("precise", F.lit(PRECISE_ELSE))) | (F.col("recall") == 1)
    level = F.when(article & ~low, 2).when(video & (F.col("recall") == 2), 2).otherwise(1)
    pop = F.when(F.col("recall") == 3, 1).when(video & (F.col("recall") == 2), 1).when(article & low & (F.col("prob") >= F.coalesce("delay", F.lit(DELAY_ELSE))), 1).otherwise(0)
    return e.withColumns({"level": level, "pop": pop}).drop("_t", "precise", "delay")


def verdicts(details: DataFrame) -> DataFrame:
    """doc_id, title_num, fst_num (all errors of the body), all_num, typo_level, typo_pop_result of documents with details (with data_type)."""
    title = F.col("sno") == 0
    weight = F.when(title, TITLE_SCORE).otherwise(BODY_SCORE)
    out = details.groupBy("doc_id").agg(
        F.count_if(title).alias("title_num"), F.count_if(~title).alias("fst_num"), F.count("*").alias("all_num"),
        F.sum(F.when(F.col("level") == 2, weight).otherwise(0)).alias("_score"), F.sum(F.when(F.col("pop") == 1, weight).otherwise(0)).alias("_pop"),
        F.max(F.when((F.col("level") == 1) & title, 1).otherwise(0)).alias("_title"), F.max("data_type").alias("_kind"),
    )
    level = F.when(F.col("_score") >= VERDICT_SCORE, 2).when((F.col("all_num") >= MANY_DETAILS) | ((F.col("_kind") == 1) & (F.col("all_num") > 0)) | (F.col("_title") == 1), 1).otherwise(0)
    return out.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("title_num", "fst_num", "all_num")], level.alias("typo_level"), F.when(F.col("_pop") >= VERDICT_SCORE, 1).otherwise(0).alias("typo_pop_result"))


def sentence_judgement(tags: DataFrame, least: float = 0.5) -> DataFrame:
    """Sentences by a labeller's chances (chars, probs: arrays): prob (the highest), wrong, and hits (char, pos, prob) above `least`."""
    hits = F.filter(F.transform("probs", lambda p, i: F.struct(F.get("chars", i).alias("char"), i.alias("pos"), p.alias("prob"))), lambda x: x["prob"] > least)
    return tags.withColumn("prob", F.coalesce(F.array_max("probs"), F.lit(0.0))).withColumns({"wrong": F.col("prob") > least, "hits": hits})


def corrections(hits: DataFrame, below: float = 0.7) -> DataFrame:
    """doc_id, sno, char_pos, correction: of candidates (cand, ratio, rank) of the word around a hit the first below `below`, else the one of least perplexity, else a homophone of the character (single), else 'X'."""
    return hits.groupBy("doc_id", "sno", "char_pos").agg(F.coalesce(F.min_by(F.when(F.col("ratio") < below, F.col("cand")), F.when(F.col("ratio") < below, F.col("rank"))), F.min_by("cand", "ratio"), F.min("single"), F.lit("X")).alias("correction"))
