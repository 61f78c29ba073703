"""Documents to paragraphs, sentences, clauses, words and characters, with the limits on a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Limits of a document, a sentence and a clause.
MAX_CHARS, MAX_SENTENCES, MAX_WORDS, MAX_CLAUSE = 2000, 70, 150, 90
#: Dictionary words are at most this long in maximum matching.
LONGEST = 8


def paragraphs_of(body: Column, separator: str = T.PARAGRAPH) -> Column:
    return F.split(body, separator, -1)


def sentences_of(paragraph: Column, ends: str = T.SENTENCE_END) -> Column:
    """Sentences with their end marks; a leading end mark opens the first."""
    flat = F.translate(paragraph, "\t\r\n", "   ")
    return F.filter(F.regexp_extract_all(flat, F.lit(f"(?s).*?(?:{ends})+|.+$"), F.lit(0)), lambda s: s != "")


def paragraph_rows(docs: DataFrame, body: str = "body", separator: str = T.PARAGRAPH, most_chars: int = MAX_CHARS) -> DataFrame:
    """docs' other columns, para (from 1), paragraph: as many paragraphs as stay within `most_chars` characters together.

    The running length is over one document's array, so nothing is shuffled.
    """
    paras = paragraphs_of(T.clean(F.coalesce(F.col(body), F.lit(""))) if separator == T.PARAGRAPH else F.coalesce(F.col(body), F.lit("")), separator)
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def add(acc: Column, p: Column) -> Column:
        total = acc["sum"] + F.length(p)
        over = acc["over"] | (total > most_chars)
        return F.struct(total.alias("sum"), F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p))).alias("kept"), over.alias("over"))

    kept = F.aggregate(paras, start, add, lambda acc: acc["kept"])
    rest = [c for c in docs.columns if c != body]
    return docs.select(*rest, F.posexplode(kept).alias("para", "paragraph")).withColumn("para", F.col("para") + 1)


def sentence_rows(docs: DataFrame, separator: str = T.PARAGRAPH, ends: str = T.SENTENCE_END, own: str = T.HAN, most_chars: int = MAX_CHARS, most_sentences: int = MAX_SENTENCES) -> DataFrame:
    """doc_id, data_type, sno, para, sentence: the title is sentence 0 of paragraph 0, valid sentences of the body count from 1.

    A paragraph is taken while fewer than `most_sentences` sentences came before it. One row a document goes in and its
    sentences come out of the same row: no shuffle, whatever the number of documents.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    paras = paragraphs_of(T.clean(body) if separator == T.PARAGRAPH else body, separator)
    kind = "struct<sum:int,n:int,over:boolean,out:array<struct<sno:int,para:int,sentence:string>>>"
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("over"), F.array().cast("array<struct<sno:int,para:int,sentence:string>>").alias("out")).cast(kind)
    numbered = F.transform(paras, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i")))

    def add(acc: Column, x: Column) -> Column:
        total = acc["sum"] + F.length(x["p"])
        over = acc["over"] | (total > most_chars) | (acc["n"] >= most_sentences)
        valid = F.filter(F.transform(sentences_of(x["p"], ends), lambda s: T.without_spaces(s) if own == T.HAN else F.trim(s)), lambda s: T.valid_sentence(s, own))
        rows = F.transform(valid, lambda s, j: F.struct((acc["n"] + j + 1).alias("sno"), x["i"].alias("para"), s.alias("sentence")))
        return F.struct(total.alias("sum"), F.when(over, acc["n"]).otherwise(acc["n"] + F.size(valid)).alias("n"), over.alias("over"), F.when(over, acc["out"]).otherwise(F.concat(acc["out"], rows)).alias("out")).cast(kind)

    title = T.without_spaces(T.clean(F.coalesce(F.col("title"), F.lit(""))), wide=True) if own == T.HAN else F.trim(F.coalesce(F.col("title"), F.lit("")))
    first = F.when(title != "", F.array(F.struct(F.lit(0).alias("sno"), F.lit(0).alias("para"), title.alias("sentence")))).otherwise(F.array().cast("array<struct<sno:int,para:int,sentence:string>>"))
    rows = F.when(body == "", first).otherwise(F.concat(first, F.aggregate(numbered, start, add, lambda acc: acc["out"])))
    return docs.select("doc_id", F.coalesce(F.col("data_type"), F.lit(0)).alias("data_type"), F.explode(rows).alias("s")).select("doc_id", "data_type", "s.sno", "s.para", "s.sentence")


def offsets(words: Column) -> Column:
    """Where each word begins, in characters."""
    return F.transform(words, lambda _, i: F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda n, w: n + F.length(w)))


def latin_words(sentence: Column) -> Column:
    """Runs of letters and digits, and every other character but white space."""
    return F.regexp_extract_all(sentence, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"), F.lit(0))


def segmenter(words: set[str], longest: int | None = None):
    """A segmenter of Han text by maximum matching with the fewest words, ties to the more frequent shape: as a function of a text column.

    words: a bounded dictionary. Runs of Latin letters, digits and other characters are words too. Pluggable: anything that
    maps a text column to an array of words whose concatenation is the text will do.
    """
    top = min(longest or LONGEST, max(map(len, words), default=1))

    def cut(text: str) -> list[str]:
        n = len(text)
        best, step = [0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            run = 1
            if text[i].isascii() and text[i].isalnum():
                while i + run < n and text[i + run].isascii() and text[i + run].isalnum():
                    run += 1
            best[i], step[i] = 1 + best[i + run], run
            for size in range(2, min(top, n - i) + 1):
                if 1 + best[i + size] <= best[i] and text[i : i + size] in words:
                    best[i], step[i] = 1 + best[i + size], size
        out, i = [], 0
        while i < n:
            out.append(text[i : i + step[i]])
            i += step[i]
        return out

    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return segment


def word_rows(sentences: DataFrame, words: Column, most: int = MAX_WORDS) -> DataFrame:
    """sentences with words, offsets and their rows: idx, word, char_off. `most` words a sentence."""
    return sentences.withColumn("words", F.slice(words, 1, most)).withColumn("offs", offsets(F.col("words"))).select(*sentences.columns, F.posexplode(F.arrays_zip("words", "offs")).alias("idx", "w")).select(*sentences.columns, "idx", F.col("w.words").alias("word"), F.col("w.offs").alias("char_off"))


def clauses_of(words: Column) -> Column:
    """Clauses of a sentence, as arrays of (idx, word, off): cut at commas and spaces, of words in half width and lower case.

    Of the last clause a final punctuation word goes if the clause has two words or more. Empty clauses and those of more
    than MAX_CLAUSE words are left out.
    """
    item = "struct<idx:int,word:string,off:int>"
    offs = offsets(words)
    items = F.transform(words, lambda w, i: F.struct(i.alias("idx"), T.uniform(w).alias("word"), F.get(offs, i).alias("off")).cast(item))
    start = F.array(F.array().cast(f"array<{item}>"))
    separator = lambda x: x["word"].isin(",", "，", " ")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(x))))
        return F.when(separator(x), F.concat(acc, F.array(F.array().cast(f"array<{item}>")))).otherwise(grown)

    cut = F.aggregate(items, start, add)
    last = F.element_at(cut, -1)
    trimmed = F.when((F.size(last) > 1) & T.is_punctuation(F.element_at(last, -1)["word"]), F.slice(last, F.lit(1), F.size(last) - 1)).otherwise(last)
    all_clauses = F.concat(F.slice(cut, F.lit(1), F.size(cut) - 1), F.array(trimmed))
    return F.filter(all_clauses, lambda c: (F.size(c) >= 1) & (F.size(c) <= MAX_CLAUSE))


def character_rows(words: DataFrame) -> DataFrame:
    """Characters of word rows: columns of words, char, char_pos (in the sentence), in_word (in the word)."""
    return words.select("*", F.posexplode(F.split("word", "")).alias("in_word", "char")).withColumn("char_pos", F.col("char_off") + F.col("in_word"))


def runs(rows: DataFrame, keys: list[str], order: str, member: Column, least: int = 2) -> DataFrame:
    """rows whose `member` holds in runs of `least` consecutive rows or more: columns run (its first row's order) and run_length."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_m", member).withColumn("_b", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(w)).filter("_m")
    of = Window.partitionBy(*keys, "_b")
    return marked.withColumns({"run": F.min(order).over(of), "run_length": F.count("*").over(of)}).filter(F.col("run_length") >= least).drop("_m", "_b")


def delimited(text: Column, pairs: tuple = (('"', '"'), ("《", "》"), ("“", "”"), ("‘", "’"), ("【", "】"), ("(", ")"))) -> Column:
    """Pieces of text between paired marks, marks included, of each kind in turn; marks of a pair that don't pair up protect nothing."""
    found = []
    for a, b in pairs:
        x, y = T.character_class(a), T.character_class(b)
        found.append(F.regexp_extract_all(text, F.lit(f"{x}[^{x[1:-1]}{y[1:-1]}]*{y}" if a != b else f"{x}[^{x[1:-1]}]*{x}"), F.lit(0)))
    return F.concat(*found)
