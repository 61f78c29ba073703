"""Joins of the engine: lexicon lookups, interval and as-of joins, priority merges, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.lexicons import small


def lookup(rows: DataFrame, lexicon: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """rows with the lexicon's other columns where rows[k] equals lexicon[v] for all k, v of `on`. The lexicon is broadcast if its size is checked to be small."""
    keys = {v: f"_{v}" for v in on.values()}
    table = small(lexicon.withColumnsRenamed(keys))
    same = None
    for k, v in on.items():
        same = (rows[k] == table[f"_{v}"]) if same is None else same & (rows[k] == table[f"_{v}"])
    return rows.join(table, same, how).drop(*keys.values())


def having(rows: DataFrame, lexicon: DataFrame, on: dict[str, str]) -> DataFrame:
    return lookup(rows, lexicon.select(*on.values()), on, "left_semi")


def lacking(rows: DataFrame, lexicon: DataFrame, on: dict[str, str]) -> DataFrame:
    return lookup(rows, lexicon.select(*on.values()), on, "left_anti")


def neighbours(words: DataFrame, keys: list[str], order: str = "idx", word: str = "word") -> DataFrame:
    """words with prev_word and next_word within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return words.withColumns({"prev_word": F.lag(word).over(w), "next_word": F.lead(word).over(w)})


def windows(words: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` consecutive entries of an array, as structs of begin, n and words."""
    sizes = F.sequence(F.lit(least), F.lit(most))
    return F.flatten(
        F.transform(sizes, lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct((i - 1).alias("begin"), n.alias("n"), F.slice(words, i, n).alias("words")))).otherwise(F.array().cast("array<struct<begin:int,n:int,words:array<string>>>")))
    )


def within_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "pos", begin: str = "begin", end: str = "end", width: int = 64) -> DataFrame:
    """points ⨝ spans with begin <= at < end: an equi-join on keys and a bin of positions, so no key's rows meet in pairs."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width)))) if width else spans
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    return p.join(binned.filter(F.col(end) > F.col(begin)), [*keys, "_bin"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, value: str) -> DataFrame:
    """points with the `value` of the first mark at or after each point, null behind the last: one sort of both sides together, no join."""
    rest = [c for c in points.columns if c not in (*keys, at)]
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in rest]).alias("_row") if rest else F.struct(F.lit(0).alias("_")).alias("_row"))
    left = left.withColumn("_value", F.lit(None).cast(marks.schema[value].dataType))
    right = marks.select(*keys, F.col(mark).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = left.unionByName(right).withColumn("_next", F.first("_value", ignorenulls=True).over(w)).filter("_side = 0")
    return out.select(*keys, F.col("_at").alias(at), *[F.col("_row")[c].alias(c) for c in rest], F.col("_next").alias(value))


def merged(preferred: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the preferred side's where both have the key."""
    a, b = preferred.select(key, F.col(value).alias("_a")), other.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_a", "_b").alias(value))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return top(rows, keys, order, 1)


def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each key. Spark limits ranks before its shuffle too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def most_frequent(lists: DataFrame, frequency: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k values of each key with the highest frequency, which is 0 where unknown; ties to the smaller value."""
    f = frequency.select(F.col("word").alias(value), "freq")
    return top(lists.join(f, value, "left").withColumn("freq", F.coalesce("freq", F.lit(0))), [key], [F.desc("freq"), value], k)


def gap_free_cells(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first candidate of every lattice cell (keys, begin, end)."""
    return first_by(candidates, [*keys, "begin", "end"], order)


def lattice_paths(clauses: DataFrame, arcs: DataFrame, keys: list[str], score, k: int = 5, beam: int = 50) -> DataFrame:
    """keys, rank, words, ppl: the k best ways through a clause's lattice of its own words and arcs (begin, end, text, rank).

    score: perplexity of a list of words. Only ways no worse than the clause itself are kept. Beam search within a clause;
    clauses have MAX_CLAUSE words at most.
    """
    import pandas as pd

    listed = arcs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "rank", "text"))).alias("arcs"))
    rows = clauses.join(listed, keys, "left")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clauses.schema if f.name in keys)

    def search(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                words = list(r["words"])
                by: dict[int, list] = {}
                for a in [] if r["arcs"] is None else r["arcs"]:
                    by.setdefault(a["begin"], []).append((a["end"], a["text"].split()))
                ways: list[list[list[str]]] = [[] for _ in range(len(words) + 1)]
                ways[0] = [[]]
                for i in range(len(words)):
                    ways[i] = sorted(ways[i], key=lambda w: (score(w), w))[:beam]
                    for w in ways[i]:
                        ways[i + 1].append([*w, words[i]])
                        for end, text in by.get(i, []):
                            ways[end + 1].append([*w, *text])
                most = score(words)
                best = sorted({(p, tuple(w)) for w in ways[-1] if (p := score(w)) <= most})[:k]
                out += [{**{c: r[c] for c in keys}, "rank": n, "words": list(w), "ppl": p} for n, (p, w) in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=[*keys, "rank", "words", "ppl"])

    return rows.select(*keys, "words", "arcs").mapInPandas(search, f"{types}, rank int, words array<string>, ppl double")
