"""N-gram language models as tables, and perplexity of word arrays.

A model is a table of grams and counts made by grouped aggregation. Corpus scoring joins with it; scoring of short clauses
reads a bounded copy of it on every executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a clause's beginning and end.
BEGIN, END = "<s>", "</s>"
#: Grams that may be handed to every executor.
MOST_GRAMS = 5_000_000
ALPHA = 0.1


def grams(sentences: DataFrame, words: str = "words") -> DataFrame:
    """prev, word, c: counts of pairs with begin and end marks. Partial sums before the shuffle."""
    marked = F.concat(F.array(F.lit(BEGIN)), F.col(words), F.array(F.lit(END)))
    pairs = F.zip_with(F.slice(marked, F.lit(1), F.size(marked) - 1), F.slice(marked, F.lit(2), F.size(marked) - 1), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    return sentences.select(F.explode(pairs).alias("g")).groupBy("g.prev", "g.word").agg(F.count("*").alias("c"))


def unigrams(sentences: DataFrame, words: str = "words") -> DataFrame:
    return sentences.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def perplexity(log10: Column, words: Column) -> Column:
    """10 ** (-log10 probability / (words + 1)): the end counts as a word."""
    return F.pow(F.lit(10.0), -log10 / (words + 1))


def corpus_perplexity(sentences: DataFrame, model: DataFrame, keys: list[str], words: str = "words", alpha: float = ALPHA) -> DataFrame:
    """keys, n, log10, ppl of every sentence under add-alpha pair probabilities, by two joins with the model's tables."""
    vocabulary = model.select("word").distinct().count()
    of_prev = model.groupBy("prev").agg(F.sum("c").alias("total"))
    table = model.join(of_prev, "prev").select("prev", "word", F.log10((F.col("c") + alpha) / (F.col("total") + alpha * vocabulary)).alias("lp"))
    unseen = of_prev.select("prev", F.log10(F.lit(alpha) / (F.col("total") + alpha * vocabulary)).alias("lp0"))
    marked = F.concat(F.array(F.lit(BEGIN)), F.col(words), F.array(F.lit(END)))
    pairs = F.zip_with(F.slice(marked, F.lit(1), F.size(marked) - 1), F.slice(marked, F.lit(2), F.size(marked) - 1), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    # equal pairs of a sentence are one row with a weight, so frequent words don't multiply the join
    rows = sentences.select(*keys, F.explode(pairs).alias("g")).groupBy(*keys, "g.prev", "g.word").agg(F.count("*").alias("times"))
    scored = rows.join(table, ["prev", "word"], "left").join(unseen, "prev", "left").withColumn("lp", F.coalesce("lp", "lp0", F.lit(math.log10(1 / max(1, vocabulary)))))
    out = scored.groupBy(*keys).agg((F.sum("times") - 1).alias("n"), F.sum(F.col("lp") * F.col("times")).alias("log10"))
    return out.withColumn("ppl", perplexity(F.col("log10"), F.col("n")))


def out_of_vocabulary(words: DataFrame, model: DataFrame, word: str = "word") -> DataFrame:
    """words with a column oov: not in the model."""
    known = model.select(F.col("word").alias("_w")).distinct().withColumn("_known", F.lit(True))
    return words.join(known, F.col(word) == F.col("_w"), "left").withColumn("oov", F.col("_known").isNull()).drop("_w", "_known")


@dataclass
class PairModel:
    """A bounded model in memory, with interpolated probabilities of pairs and words."""

    pairs: dict[tuple[str, str], int]
    words: dict[str, int]
    prevs: dict[str, int] = field(default_factory=dict)
    weight: float = 0.9

    @classmethod
    def of(cls, model: DataFrame, most: int = MOST_GRAMS) -> PairModel:
        """Collects the model, which must have `most` grams at most."""
        rows = model.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} grams: score with corpus_perplexity")
        pairs, words, prevs = {}, {}, {}
        for r in rows:
            pairs[r["prev"], r["word"]] = r["c"]
            words[r["word"]] = words.get(r["word"], 0) + r["c"]
            prevs[r["prev"]] = prevs.get(r["prev"], 0) + r["c"]
        return cls(pairs, words, prevs)

    def known(self, word: str) -> bool:
        return word in self.words

    def scores(self, words: list[str]) -> list[float]:
        """log10 of each word given the one before, the end last."""
        total, size, out, prev = sum(self.words.values()) if not hasattr(self, "_total") else self._total, len(self.words) + 1, [], BEGIN
        self._total = total
        for w in [*words, END]:
            single = (self.words.get(w, 0) + ALPHA) / (total + ALPHA * size)
            pair = self.pairs.get((prev, w), 0) / self.prevs[prev] if prev in self.prevs else 0.0
            out.append(math.log10(self.weight * pair + (1 - self.weight) * single))
            prev = w
        return out

    def ppl(self, words: list[str]) -> float:
        return 10 ** (-sum(self.scores(words)) / (len(words) + 1))


def scorer(score: Callable[[list[str]], float]):
    """A function of a column of word arrays from any perplexity of a list of words, such as an external model's, which is loaded once a worker."""

    @F.pandas_udf("double")
    def ppl(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in words:
            yield s.map(lambda w: score(list(w)) if w is not None else None)

    return ppl


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similar_words(pairs: DataFrame, vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """pairs (a, b) with similar: both have vectors, and their cosine is above `least`."""
    va, vb = vectors.select(F.col("word").alias("a"), F.col("vec").alias("_a")), vectors.select(F.col("word").alias("b"), F.col("vec").alias("_b"))
    return pairs.join(va, "a", "left").join(vb, "b", "left").withColumn("similar", F.coalesce(cosine(F.col("_a"), F.col("_b")) > least, F.lit(False))).drop("_a", "_b")
