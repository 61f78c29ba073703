"""Language-model scores: smoothed word counts, and the marginal likelihood of a subword lattice.

The lattice of a word has an arc for every piece of an existing vocabulary that matches its text, and byte pieces for a
character that is no piece. A forward recursion in log space sums the weights of all segmentations, so a word's probability is
marginal, not that of its best segmentation; a document's is the product over its words and an end piece.
The vocabulary is never trained. Its pieces come with ranks, not probabilities: weights start from a power law of the rank
and one expectation step over the training words' lattices (forward and backward) makes them fit the corpus.

Counts of words are unbounded, so they stay distributed. The counts of the most frequent words, a table of bounded size, are
handed to every scorer and settle most tokens in place; the other tokens meet their counts in a join on the word's hash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small_batches, written

#: Smoothing of word counts.
ALPHA = 0.1
#: One document in FOLDS is held out.
FOLDS = 10
#: Most words whose counts are handed to every scorer.
FREQUENT = 1 << 18
#: Words of more characters go through their lattices one by one, others many of a length at once. Results are the same.
LONG = 64
#: Words that go through their lattices at once.
TOGETHER = 20_000
#: Positions of a long word whose arcs are held at once.
STRETCH = 8192
#: Share of the weights that goes to the ranks' power law after the expectation step.
PRIOR = 0.01
#: Starting shares of the byte pieces and of the end piece.
BYTES_SHARE, END_SHARE = 1e-4, 1e-2
SPACE = "▁"
#: Numbers of the pieces that are in no text: all byte pieces, which share one weight evenly, and the end. Others follow.
BYTE, END, FIRST = 0, 1, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces that can stand in a word (a leading space mark at most), and the starting weights of all piece numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or SPACE in name[1:]):
            ranks.setdefault(name, max(0.0, -model.get_score(i)))
    law = 1 / (np.array(list(ranks.values())) + 100)
    return list(ranks), np.r_[BYTES_SHARE, END_SHARE, law / law.sum() * (1 - BYTES_SHARE - END_SHARE)]


_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _prefixes(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of all prefixes of pieces, the number of the piece that each is (-1: none), the longest piece."""
    numbers: dict[int, int] = {}
    names = pieces(path)[0]
    for number, name in enumerate(names, FIRST):
        h = 0
        for at, ch in enumerate(name, 1):
            h = (h * int(_BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            if at == len(name):
                numbers[h] = number
            else:
                numbers.setdefault(h, -1)
    keys = np.array(sorted(numbers), np.uint64)
    return keys, np.array([numbers[int(k)] for k in keys], np.int64), max(map(len, names))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """Lattices over one vocabulary and its weights, many words at a time."""

    def __init__(self, path: str, weights: np.ndarray | None = None):
        self.keys, self.numbers, self.longest = _prefixes(path)
        self.weights = pieces(path)[1] if weights is None else weights
        self.log = np.log(self.weights)
        self.log_byte = self.log[BYTE] - np.log(256)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """codes: a row of code points per text, all of one length. Log weights up to each position, and the arcs by start."""
        rows, length = codes.shape
        alpha = np.full((length + 1, rows), -np.inf)
        alpha[0] = 0
        arcs = []
        for i in range(length):
            at, h = np.arange(rows), np.zeros(rows, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                c = codes[at, j - 1]
                h = h * _BASE + c.astype(np.uint64) + np.uint64(1)
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                alive = self.keys[k] == h
                number = np.where(alive, self.numbers[k], -1)
                if j == i + 1:  # what is no piece is spelled in bytes
                    bytes_ = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                    weight = np.where(number < 0, bytes_ * self.log_byte, self.log[number])
                    number = np.where(number < 0, -bytes_, number)
                    arcs.append((i, j, at, number, weight))
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + weight)
                else:
                    hit = number >= 0
                    who, number = at[hit], number[hit]
                    if len(who):
                        weight = self.log[number]
                        arcs.append((i, j, who, number, weight))
                        alpha[j, who] = np.logaddexp(alpha[j, who], alpha[i, who] + weight)
                at, h = at[alive], h[alive]
                if not len(at):
                    break
        return alpha, arcs

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length after a space mark, but long ones: their numbers, code points."""
        by: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            if len(w) < LONG:
                by.setdefault(len(w) + 1, []).append(n)
        for length, who in by.items():
            for i in range(0, len(who), TOGETHER):
                some = who[i : i + TOGETHER]
                yield np.array(some), _codes([SPACE + words[n] for n in some]).reshape(len(some), length)

    def _stretch(self, codes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, piece number (bytes: less than 0) and log weight of the arcs from STRETCH positions of one word, by start."""
        at = np.arange(start, min(start + STRETCH, len(codes)))
        h = np.zeros(len(at), np.uint64)
        found = []
        for size in range(1, self.longest + 1):
            c = codes[at + size - 1]
            h = h * _BASE + c.astype(np.uint64) + np.uint64(1)
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            alive = self.keys[k] == h
            number = np.where(alive, self.numbers[k], -1)
            if size == 1:  # what is no piece is spelled in bytes
                bytes_ = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                found.append((at, at + 1, np.where(number < 0, -bytes_, number), np.where(number < 0, bytes_ * self.log_byte, self.log[number])))
            else:
                hit = number >= 0
                found.append((at[hit], at[hit] + size, number[hit], self.log[number[hit]]))
            alive &= at + size < len(codes)
            at, h = at[alive], h[alive]
            if not len(at):
                break
        i, j, number, weight = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(i, kind="stable")
        return i[order], j[order], number[order], weight[order]

    def _long_forward(self, codes: np.ndarray, keep: np.ndarray | None = None) -> float:
        """The log weight of all segmentations of one word. keep: gets that up to each position; else only the last `longest` are held."""
        ring = self.longest + 1
        into: list[list[float]] = [[] for _ in range(ring)]
        into[0].append(0.0)
        done, here = -1, 0.0
        for start in range(0, len(codes), STRETCH):
            i, j, _, weight = self._stretch(codes, start)
            for a, b, w in zip(i.tolist(), j.tolist(), weight.tolist(), strict=True):
                if a != done:
                    here, done = _log_sum(into[a % ring]), a
                    into[a % ring] = []
                    if keep is not None:
                        keep[a] = here
                into[b % ring].append(here + w)
        total = _log_sum(into[len(codes) % ring])
        if keep is not None:
            keep[len(codes)] = total
        return total

    def _long_expected(self, word: str, times: float, out: np.ndarray) -> None:
        """Adds to out what expected() says of one word, the arcs made again stretch by stretch from its end."""
        codes = _codes([SPACE + word])
        alpha = np.empty(len(codes) + 1)
        total = self._long_forward(codes, alpha)
        beta = np.empty(len(codes) + 1)
        beta[-1] = 0
        for start in reversed(range(0, len(codes), STRETCH)):
            i, j, number, weight = self._stretch(codes, start)
            stop = min(start + STRETCH, len(codes))
            after = beta[stop : stop + self.longest + 1].tolist()
            known = [0.0] * (stop - start) + after
            ways: list[float] = []
            starts, ends, weights = i.tolist(), j.tolist(), weight.tolist()
            for n in range(len(starts) - 1, -1, -1):
                ways.append(weights[n] + known[ends[n] - start])
                if not n or starts[n - 1] != starts[n]:
                    known[starts[n] - start] = _log_sum(ways)
                    ways = []
            beta[start:stop] = known[: stop - start]
            share = times * np.exp(alpha[i] + weight + beta[j] - total)
            out += np.bincount(np.where(number < 0, BYTE, number), share * np.where(number < 0, -number, 1), len(out))

    def log10(self, words: list[str]) -> np.ndarray:
        """Of each word, the log10 of the sum of all its segmentations' weights."""
        out = np.zeros(len(words))
        for who, codes in self._by_length(words):
            out[who] = self._forward(codes)[0][-1]
        for n, w in enumerate(words):
            if len(w) >= LONG:
                out[n] = self._long_forward(_codes([SPACE + w]))
        return out / np.log(10)

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The expected count of each piece number over all segmentations, each word counted so many times."""
        out = np.zeros(len(self.weights))
        for who, codes in self._by_length(words):
            alpha, arcs = self._forward(codes)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, at, number, weight in reversed(arcs):
                beta[i, at] = np.logaddexp(beta[i, at], weight + beta[j, at])
            for i, j, at, number, weight in arcs:
                share = times[who[at]] * np.exp(alpha[i, at] + weight + beta[j, at] - alpha[-1, at])
                out += np.bincount(np.where(number < 0, BYTE, number), share * np.where(number < 0, -number, 1), len(out))
        for n, w in enumerate(words):
            if len(w) >= LONG:
                self._long_expected(w, times[n], out)
        return out


def _log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    most = max(x)
    return most + math.log(sum([math.exp(a - most) for a in x]))


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo the number of folds, is 0. A null id's text is empty."""
    return zlib.crc32(b"" if pd.isna(doc_id) else str(int(doc_id)).encode()) % FOLDS == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c: counts over the training documents, 0 for words that only others have. Summed in the workers first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        other: set = set()

        def sent() -> pd.DataFrame:
            other.difference_update(total)
            out = pd.DataFrame({"word": [*total.keys(), *other], "c": [*total.values(), *[0] * len(other)]}, columns=["word", "c"])
            total.clear()
            other.clear()
            return out

        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                (other if held_out(i) else total).update(_words(t))
                if len(total) + len(other) > 1_000_000:
                    yield sent()
        yield sent()

    return docs.select("doc_id", "text").mapInPandas(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of words joined to TOGETHER rows or more."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= TOGETHER:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def fitted(counts: DataFrame, documents: int, path: str) -> np.ndarray:
    """Weights after one expectation step over the training words, mixed with the starting ones. The end piece counts once a document.

    The driver gets a number for each piece of the vocabulary, summed before: a fixed size.
    """
    start = pieces(path)[1]

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, into = Lattice(path), np.zeros(len(start))
        for b in _gathered(batches):
            into += lattice.expected([w.decode() for w in b["word"]], b["c"].to_numpy(float))
        at = np.flatnonzero(into)
        yield pd.DataFrame({"piece": at.astype(np.int32), "n": into[at]})

    n = np.zeros(len(start))
    for r in counts.filter("c > 0").mapInPandas(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[r["piece"]] = r["n"]
    n[END] = documents
    return start if not n.sum() else (1 - PRIOR) * n / n.sum() + PRIOR * start


def frequent_floor(counts: DataFrame, most: int) -> int:
    """The least count whose words number `most` at most. Found from a histogram of counts' logarithms, which is short however many words there are."""
    steps = counts.filter("c > 0").groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    floor, total = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        floor = r["least"]
    return floor


@small_batches
def score(docs: DataFrame, vocabulary: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (columns doc_id, text).

    Tokens are the words of the whole lower-cased text (A-Z; runs of anything but ASCII white space) and one end. Null and
    empty texts are the end alone. A null doc_id counts as the text ''. base_score is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))); score is the lattice model's log10 probability. Rows with the same doc_id are
    documents each, in one fold. Without training documents N and V are 0 and the lattice keeps its starting weights.
    Other columns are ignored. Words beyond the frequent ones meet their counts by 64-bit hashes.
    """
    path = vocabulary or default_vocabulary()
    counts = written(word_counts(docs), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    training = docs.select("doc_id").filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) != 0).count()
    n, v = (total["n"] or 0) + training, total["v"] + (training > 0)
    norm = float(np.log10(n + ALPHA * (v + 1)))
    weights = fitted(counts, training, path)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path, weights)
        for b in _gathered(batches):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, b["word"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"h": h, "word": b["word"], "c": b["c"], "l": lattice.log10([w.decode() for w in b["word"]])})

    words = written(counts.mapInPandas(likely, "h long, word binary, c long, l double"), "lm-words")
    discard(counts)
    floor = frequent_floor(words, frequent)
    known = {bytes(r["word"]): (float(np.log10(r["c"] + ALPHA)), r["l"]) for r in words.filter(F.col("c") >= floor).select("word", "c", "l").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)  # `frequent` words at most
    end, end_base = float(np.log10(weights[END])), float(np.log10(training + ALPHA))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                times = Counter(_words(t))
                base, log10, hit, rare = end_base, end, int(training > 0), []
                for w, x in times.items():
                    if (k := known.get(w)) is None:
                        rare.append(w)
                    else:
                        base += x * k[0]
                        log10 += x * k[1]
                        hit += x
                rows.append((None if pd.isna(i) else int(i), held_out(i), 1 + times.total(), hit, base, log10, list(map(xxhash.xxh3_64_intdigest, rare)), [times[w] for w in rare]))
            out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "hit", "base", "log10", "rare", "times"])
            out["rare"] = [np.array(x, np.uint64).view(np.int64) for x in out["rare"]]
            yield out.astype({"doc_id": "Int64"})

    # a row's number tells apart documents that share an id; it is written down before it is used
    shape = "doc_id long, held_out boolean, n_tokens long, hit long, base double, log10 double, rare array<long>, times array<int>"
    first = written(docs.select("doc_id", "text").mapInPandas(scored, shape).withColumn("row", F.monotonically_increasing_id()), "lm-first")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), "x.times")
    met = rare.join(words.filter(F.col("c") < floor).select("h", "c", "l"), "h").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + ALPHA)).alias("late"), F.sum(F.col("times") * F.col("l")).alias("late_log10"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("late_hit")
    )
    out = first.drop("rare", "times").join(met, "row", "left")
    nothing = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hit") + F.coalesce("late_hit", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("late", nothing) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("log10") + F.coalesce("late_log10", nothing)).alias("score"),
    )
