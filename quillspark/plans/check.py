"""The whole proofreading dataflow: documents in, details and summaries out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import phonetic
from quillspark.functions import text as T
from quillspark.operators import detect, entities, lm, resolve, split
from quillspark.plans.stages import stage


@dataclass
class Models:
    """Everything that is plugged in. Defaults need no outside model."""

    segment: Callable[[Column], Column]  # text to words
    perplexity: Callable[[list[str]], float]  # of words
    lexicons: detect.Lexicons = field(default_factory=detect.Lexicons)
    readings: dict[str, str] = field(default_factory=dict)
    known: Callable[[Column], Column] | None = None  # word to whether the model has it
    tag: Callable[[DataFrame], DataFrame] | None = None  # sentences with words to entities: doc_id, sno, idx, n, cls
    classical: Callable[[Column], Column] | None = None  # sentence to whether it is classical text
    label: Callable[[DataFrame], DataFrame] | None = None  # sentences to labels of resolve.with_labels
    genders: DataFrame | None = None  # key, value
    wrong_names: DataFrame | None = None  # key, value
    casts: DataFrame | None = None  # title, py, name, rank
    listed_names: DataFrame | None = None  # name
    titles: DataFrame | None = None  # py, name, rank
    wrong_places: DataFrame | None = None  # key, value
    unimportant: set[str] = field(default_factory=set)
    neural: Callable[[dict], list[dict]] | None = None
    correct: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # hits and sentences to doc_id, sno, char_pos, correction; see resolve.corrections
    skip_detection: bool = False  # the circuit breaker: documents get empty results
    mask_errors: bool = False  # the fail-safe: a failure leaves no mark in ret_code


def _flags(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(T.is_han(w) & (w != ""), F.lit(1)).otherwise(F.lit(-2)))


def _tagged(sentences: DataFrame, models: Models) -> tuple[DataFrame, DataFrame | None]:
    """Sentences whose flags protect entities, and the entities (doc_id, sno, cls, word, pos)."""
    if models.tag is None:
        return sentences, None
    spans = models.tag(sentences)
    listed = spans.groupBy("doc_id", "sno").agg(F.collect_list(F.struct("idx", "n", "cls")).alias("_spans"))
    out = sentences.join(listed, ["doc_id", "sno"], "left")

    def protect(flag: Column, i: Column) -> Column:
        inside = F.filter("_spans", lambda s: (s["idx"] <= i) & (i < s["idx"] + s["n"]))
        person = F.exists(inside, lambda s: s["cls"] == entities.PERSON)
        return F.when(F.coalesce(F.size("_spans"), F.lit(0)) <= 0, flag).when(person, F.lit(-2)).when(F.size(inside) > 0, F.lit(-1)).otherwise(flag)

    found = out.filter("_spans is not null").select("doc_id", "sno", "words", F.explode("_spans").alias("s"))
    found = found.select("doc_id", "sno", F.col("s.cls").alias("cls"), F.array_join(F.slice("words", F.col("s.idx") + 1, F.col("s.n")), "").alias("word"), (F.col("sno") * 1000 + F.col("s.idx")).alias("pos"))
    return out.withColumn("flags", F.transform("flags", protect)).drop("_spans"), found


def sentences(docs: DataFrame, models: Models) -> DataFrame:
    """The sentences of documents, in words, with flags; classical text is left out of articles."""
    rows = split.sentence_rows(docs)
    if models.classical is not None:
        rows = rows.filter((F.col("data_type") != 0) | (F.length("sentence") <= 1) | (T.uniform_stops(F.col("sentence")) == "") | ~models.classical(F.col("sentence")))
    rows = rows.withColumn("words", F.slice(models.segment(F.col("sentence")), 1, split.MAX_WORDS))
    return rows.withColumn("flags", _flags(F.col("words")))


def check(docs: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """details and summary of documents (sources.documents.COLUMNS). Every document has a summary.

    A sentence whose clauses fail has no errors, and its document's ret_code is -1, or 0 with models.mask_errors.
    """
    none = docs.select("doc_id").limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("sno", "int"), ("idx", "int"), ("sent", "string"), ("wrong", "string"), ("correct", "string"), ("typo", "int"), ("prob", "double"), ("ori_sent", "string"), ("term_imp", "int"), ("level", "int"), ("pop_result", "int"))])
    details, failed = (none, docs.select("doc_id").limit(0)) if models.skip_detection else _details(docs, models)
    named = details.select("doc_id", "sno", "level", F.col("pop_result").alias("pop")).join(docs.select("doc_id", "data_type"), "doc_id")
    found = resolve.verdicts(named)
    counts = ("title_num", "fst_num", "all_num", "typo_level", "typo_pop_result")
    code = F.lit(0) if models.mask_errors else F.coalesce("_code", F.lit(0))
    wrong = failed.select("doc_id").distinct().withColumn("_code", F.lit(-1))
    summary = docs.select("doc_id").join(found, "doc_id", "left").join(wrong, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], code.alias("ret_code"))
    return details, summary


def _details(docs: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """The details, and the sentences (doc_id, sno) of which a clause failed."""
    spark = docs.sparkSession
    sents, found = _tagged(sentences(docs, models), models)
    readings = F.create_map(*[F.lit(x) for kv in models.readings.items() for x in kv]) if models.readings else F.create_map().cast("map<string,string>")
    lex = models.lexicons
    if models.readings and lex.readings is None:
        lex = replace(lex, readings=readings)
    names, counted = None, None
    if found is not None:
        counted = entities.counts(found).withColumn("reading", F.array_join(phonetic.reading(F.col("word"), readings), ""))
        empty = spark.createDataFrame
        persons = entities.name_errors(
            counted, "reading", models.wrong_names if models.wrong_names is not None else empty([], "key string, value string"), models.casts if models.casts is not None else empty([], "title string, py string, name string, rank int"),
            models.listed_names if models.listed_names is not None else empty([], "name string"),
        )
        others = entities.other_errors(counted, "reading", models.titles if models.titles is not None else empty([], "py string, name string, rank int"), models.wrong_places if models.wrong_places is not None else empty([], "key string, value string"))
        names = entities.all_errors(persons, others)
    clauses = detect.clause_rows(sents, models.known)
    if lex.pass_words:
        clauses = detect.passed_windows(clauses, F.array(*[F.lit(w) for w in sorted(lex.pass_words)]))
    # the labeller speaks of a sentence once; the cascade, active labelling and the merge all read what it said
    labels = models.label(sents) if models.label is not None else None
    if labels is not None:
        wrong = labels.select("doc_id", "sno").distinct().withColumn("judged_wrong", F.lit(True))
        clauses = clauses.join(wrong, ["doc_id", "sno"], "left").withColumn("judged_wrong", F.coalesce("judged_wrong", F.lit(False)))
    if counted is not None:
        clauses = clauses.join(entities.document_entities(counted).select("doc_id", "all_names"), "doc_id", "left")
    clauses = stage(clauses, "clauses")  # every detector reads them: written once, so that the segmenter runs once a sentence
    ready = detect.scored(clauses, detect.candidates(clauses, lex, names), lm.scorer(models.perplexity))
    extra = [c for c in ("judged_wrong", "all_names") if c in clauses.columns]
    said = stage(detect.resolved(ready.select(*detect.KEY, "words", "norm", "flags", "punc", "offs", "cands", *extra), lex, models.neural), "cascades")
    failed = said.filter("error is not null").select("doc_id", "sno").distinct()
    errors = said.filter("type is not null").join(failed, ["doc_id", "sno"], "left_anti")
    errors = errors.withColumn("seq", F.col("clause") * 100 + F.col("seq"))
    base = sents.select("doc_id", "sno", "para", "data_type", "sentence")
    errors = errors.join(base, ["doc_id", "sno"]).withColumn("clause", F.col("clause_text"))
    if counted is not None:
        often = counted.filter(F.col("cls").isin(entities.PERSON, entities.VIDEO)).groupBy("doc_id", F.col("word").alias("wrong")).agg(F.max("n").alias("repeats"))
        errors = errors.join(often, ["doc_id", "wrong"], "left")
    else:
        errors = errors.withColumn("repeats", F.lit(0))

    def imp(kind: Column, wrong: Column, right: Column) -> Column:
        listed = F.array_contains(F.array(*[F.lit(w) for w in sorted(models.unimportant)]), right) if models.unimportant else F.lit(False)
        return resolve.importance(kind, wrong, right, F.col("para"), phonetic.same_reading(wrong, right, readings), listed)

    errors = errors.withColumn("term_imp", imp(F.col("type"), F.col("wrong"), F.col("right")))
    chars = resolve.characters(errors)
    if labels is not None:
        # a sentence is read by the labeller if a suspect of its clauses asked, or actively
        asked = said.filter("asked").select("doc_id", "sno").distinct()
        active = resolve.to_label(sents.select("doc_id", "sno"), errors, asked)
        read = asked.union(active.select("doc_id", "sno")).distinct()
        heard = labels.join(read, ["doc_id", "sno"], "left_semi")
        if models.correct is not None:
            heard = heard.drop("correction").join(models.correct(heard, sents), ["doc_id", "sno", "char_pos"], "left")
        right = F.coalesce("correction", F.lit("X"))
        heard = heard.join(base.select("doc_id", "sno", "para"), ["doc_id", "sno"]).withColumn("term_imp", F.when(right == "X", 2).otherwise(imp(F.lit(20), F.col("char"), right))).drop("para")
        chars = resolve.with_labels(chars, heard, sorted(lex.pass_chars), sorted(lex.pass_words))
    if models.genders is not None:
        words = split.word_rows(sents, F.col("words")).withColumn("flag", F.get("flags", F.col("idx")))
        chars = entities.pronoun_errors(words, models.genders).select(*resolve.ERROR).unionByName(chars)
    kinds = docs.select("doc_id", F.coalesce("data_type", F.lit(0)).alias("data_type"))
    chars = chars.join(kinds, "doc_id").withColumn("recall", F.when(F.col("data_type") == 1, resolve.video_recall(F.col("type"), F.col("prob"), F.col("recall"))).otherwise(F.col("recall")))
    done = resolve.levelled(resolve.frequent_dropped(chars), resolve.threshold_table(spark))
    return done.select("doc_id", "sno", F.col("char_pos").alias("idx"), F.col("clause").alias("sent"), "wrong", F.col("right").alias("correct"), F.col("type").alias("typo"), "prob", F.col("sentence").alias("ori_sent"), "term_imp", "level", F.col("pop").alias("pop_result")), failed
