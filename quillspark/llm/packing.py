"""Packing of tokenized documents into sequences by bin completion.

Pieces of equal length are interchangeable, so the search runs on the histogram of lengths: as many numbers as a sequence has
tokens, however many documents there are. Best fit is the first incumbent. Around the largest length left, bin completion
enumerates the undominated fillings: those in which no set of parts can give way to one part that is left over and takes at
least their place. A filling that wastes more than an improvement on the incumbent allows is pruned, and so is a branch whose
lower bound can't beat it. A filling is first taken as often as the histogram allows, and on backtracking once, so the
search is complete; it ends at the lower bound, or after STEPS steps with the best packing found and the gap in the log.

The packing is a short table of patterns. A piece finds its place by its rank among the pieces of its length; ranks are
counted within salted parts of a length, a million pieces each or less, and offset by the parts before, so that no length is
ordered in one task. What is handed to the workers are these offsets and the patterns: a few numbers a length, and one for
each million of pieces.
"""

from __future__ import annotations

import gc
import logging
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import claim, small_batches, written

LOG = logging.getLogger(__name__)

CAPACITY = 2048
#: Steps of the search: parts that are tried, and for each filling that is tested for dominance LEAF more.
STEPS, LEAF = 400_000, 20
#: Pieces of one length that are ranked together.
RANKED = 1 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 500_000
#: Words that are tokenized at once.
TOGETHER = 4096
#: Characters for which lower(), split() and the tokenizer's own normalizer and white space agree: such texts go word by word.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ňŊ-ž]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, int]:
    """The characters by which byte-level models read bytes: printable ones as they are, the others by rising numbers from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(rest)}


class WordIds:
    """Little-endian 32-bit ids of texts. The tokenizer splits at white space first, so a word's ids don't depend on its neighbours and are remembered."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = _byte_letters()

    def _encoded(self, words: list[str]) -> None:
        """Tokenize distinct words together; where a word's ids begin and end is told by their offsets."""
        known = self.known
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            starts = np.cumsum([0, *[len(w) + 1 for w in some]])
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            edges = (4 * np.searchsorted(np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(ids) // 4), starts)).tolist()
            for w, start, end in zip(some, edges, edges[1:], strict=False):
                known[w] = ids[start:end]

    def _learn(self, words: set[str]) -> None:
        """Punctuation after a letter or digit is a token apart, so a word with it has its own ids after those of the bare word."""
        known, ends, bare = self.known, [], set()
        for w in words:
            stem = w.rstrip(string.punctuation)
            if len(stem) < len(w) and stem and stem[-1].isalnum():
                ends.append((w, stem, w[len(stem) :]))
                bare.add(stem)
                bare.add(w[len(stem) :])
            else:
                bare.add(w)
        rest, tokenize, four = [], self.tokenizer.model.tokenize, self.four
        for w in bare.difference(known):
            if w.isalpha():  # one run of letters: the model reads its bytes, each as a character
                known[w] = b"".join([four[t.id] for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))])
            else:
                rest.append(w)
        self._encoded(rest)
        for w, stem, end in ends:
            known[w] = known[stem] + known[end]

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids, then id 0."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        split = [t.lower().split() if t and "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        found = [list(map(get, words)) if words else words for words in split]
        gaps = [(ids, words, i) for ids, words in zip(found, split, strict=True) if ids for i, x in enumerate(ids) if x is None]
        if gaps:
            self._learn({words[i] for _, words, i in gaps})
            for ids, words, i in gaps:
                ids[i] = self.known[words[i]]
        for t, ids in zip(texts, found, strict=True):
            if ids is None:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes() + b"\0\0\0\0"
            else:
                ids.append(b"\0\0\0\0")
                yield b"".join(ids)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("packing", _word_ids(path).known.clear)
        gc.disable()  # lists of many words, and no cycles: collection would only walk them again and again
        try:
            yield from parts(batches)
        finally:
            gc.enable()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some, rows = b.iloc[at : at + 500], []
                for i, ids in zip(some["doc_id"], _word_ids(path).many(some["text"].tolist()), strict=True):
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((None if pd.isna(i) else int(i), piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, ...], int]


def _times(counts: np.ndarray, lengths: list[int]) -> int:
    """How often a filling can be taken."""
    return min(int(counts[x]) // lengths.count(x) for x in set(lengths))


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The largest length left, then the largest that fits, until none does; each filling as often as it can be taken."""
    counts, out = counts.copy(), []
    while counts.any():
        lengths, room = [], capacity
        left = counts.copy()
        while (fit := np.flatnonzero(left[: room + 1])).size:
            x = int(fit[-1])
            n = min(int(left[x]), room // x)
            lengths += [x] * n
            left[x] -= n
            room -= n * x
        n = _times(counts, lengths)
        for x in lengths:
            counts[x] -= n
        out.append((tuple(lengths), n))
    return out


@lru_cache(maxsize=4)
def _shares(size: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k a row of what pieces of each length count, and how much a sequence holds of it."""
    x, k = np.arange(size), np.arange(1, 20)[:, None]
    # longer than capacity * i / (k + 1) counts as i / k of a sequence, exactly that as it is
    return np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity), k[:, 0] * capacity


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: the best of the volume, of large pieces that leave room for small ones only, and of pieces counted by how few of their like share a sequence."""
    x = np.arange(len(counts))
    total = counts * x
    best = -(-int(total.sum()) // capacity)
    # for each k: pieces above capacity - k are alone, those above a half are apart, those from k to a half fill what these leave
    half = capacity // 2
    n, t = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(total)]  # of lengths below an index
    k = np.arange(half + 1)
    alone = n[-1] - n[capacity - k + 1]
    apart, apart_tokens = n[capacity - k + 1] - n[half + 1], t[capacity - k + 1] - t[half + 1]
    small = t[half + 1] - t[k]
    best = max(best, int((alone + apart + np.maximum(0, -(-(small - (apart * capacity - apart_tokens)) // capacity))).max()))
    share, room = _shares(len(counts), capacity)
    return max(best, int((-(-(share @ counts) // room)).max()))


def _dominated(parts: list[int], spare: int, leftover: int) -> bool:
    """Whether a set of parts can give way to one part of `leftover` (a bit for each length) that is no shorter and fits, or one fits beside them."""
    fits = (1 << spare + 1) - 1
    if leftover & fits & ~1:
        return True
    single = several = 0  # a bit for each sum of one part, of more
    for p in parts:
        several |= (single | several) << p
        single |= 1 << p
    for sums, longer in ((single, 1), (several, 0)):
        while sums:
            s = (sums & -sums).bit_length() - 1
            if (leftover >> s + longer) & (fits >> longer):
                return True
            sums &= sums - 1
    return False


def _quick(left: np.ndarray, room: int) -> list[list[int]]:
    """The best one, two and three parts for a room, each if it beats those of fewer; more parts are the best of these, then the largest that fit."""
    left = left.copy()
    here = np.flatnonzero(left[: room + 1])
    if not here.size:
        return []
    below = np.zeros(room + 1, np.int64)
    below[here] = here
    below = np.maximum.accumulate(below)
    few = np.where(left[: room + 1] == 1, np.r_[0, below[:-1]], below)  # largest length up to x, for a second part where x is taken
    best = [[int(here[-1])]]
    if room > here[-1]:
        top = np.minimum(here, room - here)
        b = np.where(top == here, few[top], below[top])  # the largest part beside the first, no larger than it
        at = int(np.lexsort((-here, -(here + b)))[0])
        if b[at] and here[at] + b[at] > sum(best[-1]):
            best.append([int(here[at]), int(b[at])])
    if sum(best[-1]) < room:
        found = None
        for a in here[::-1]:
            if 3 * a < sum(best[-1]):  # three parts no larger than a are less
                break
            rest = left.copy()
            rest[a] -= 1
            c = np.flatnonzero(rest[: min(int(a), room - int(a)) + 1])
            if not c.size:
                continue
            under = np.zeros(int(c[-1]) + 1, np.int64)
            under[c] = c
            under = np.maximum.accumulate(under)
            lone = np.where(rest[: len(under)] == 1, np.r_[0, under[:-1]], under)
            top = np.minimum(np.minimum(c, room - a - c), len(under) - 1)
            d = np.where(top == c, lone[top], under[top])
            i = int(np.argmax(c + d))
            total = int(a + c[i] + d[i])
            if d[i] and total > sum(found or best[-1]):
                found = [int(a), int(c[i]), int(d[i])]
                if total == room:
                    break
        if found:
            best.append(found)
    more, spare = list(best[-1]), room - sum(best[-1])
    for x in more:
        left[x] -= 1
    while spare and (fit := np.flatnonzero(left[: spare + 1])).size:
        x = int(fit[-1])
        more.append(x)
        left[x] -= 1
        spare -= x
    if len(more) > len(best[-1]):
        best.append(more)
    return best[::-1]


def fillings(counts: np.ndarray, capacity: int, least: int, steps: list[int]) -> Iterator[list[int]]:
    """The undominated fillings of `least` tokens or more around the largest length left, lazily: those that are quickly found, then all others in depth, larger parts first.

    steps: one number, from which what is done is taken off; below 0 there are no more fillings.
    """
    largest = int(np.flatnonzero(counts)[-1])
    left = counts.copy()
    left[largest] -= 1
    room = capacity - largest
    lengths = [int(x) for x in np.flatnonzero(left[: room + 1])]
    if not lengths:
        yield [largest]
        return
    leftover = sum(1 << int(x) for x in np.flatnonzero(left))
    number = [int(left[x]) for x in lengths]
    tokens = [0]  # of the lengths before an index
    for x, n in zip(lengths, number, strict=True):
        tokens.append(tokens[-1] + x * n)

    def good(parts: list[int]) -> bool:
        steps[0] -= LEAF
        used = Counter(parts)
        rest = leftover
        for x, n in used.items():
            if n == left[x]:
                rest &= ~(1 << x)
        return largest + sum(parts) >= least and not _dominated(parts, room - sum(parts), rest)

    seen = set()
    steps[0] -= len(lengths)
    for parts in _quick(left, room):
        parts = sorted(parts, reverse=True)
        if largest + sum(parts) >= least:
            seen.add(tuple(parts))
            yield [largest, *parts]
    parts, spare, used = [], room, [0] * len(lengths)
    following = [len(lengths) - 1]  # of each depth the index of the length to try next
    fresh = True  # nothing was tried at this depth
    while following and steps[0] >= 0:
        steps[0] -= 1
        at = min(following[-1], bisect_right(lengths, spare) - 1)
        while at >= 0 and used[at] == number[at]:
            at -= 1
        if at < 0 or largest + room - spare + min(spare, tokens[at + 1]) < least:
            if at < 0 and fresh and tuple(parts) not in seen and good(parts):
                yield [largest, *parts]
            following.pop()
            if parts:
                at = bisect_right(lengths, parts[-1]) - 1
                spare += parts.pop()
                used[at] -= 1
            fresh = False
            continue
        following[-1] = at - 1  # what comes back here goes on with shorter parts
        parts.append(lengths[at])
        spare -= lengths[at]
        used[at] += 1
        following.append(at)
        fresh = True


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """A packing of counts[x] pieces of each length x into few sequences, as (lengths, times). With steps enough, into as few as can be."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    total = int((counts * np.arange(len(counts))).sum())
    least = lower_bound(counts, capacity)
    budget = [steps]

    def options(left: np.ndarray, tokens: int, used: int) -> Iterator[Pattern]:
        """Fillings that waste no more than a packing with fewer sequences than the incumbent's can, as often as they can be taken, and once."""
        waste = (fewest - 1) * capacity - total - (used * capacity - (total - tokens))
        for lengths in fillings(left, capacity, capacity - waste, budget):
            n = _times(left, lengths)
            yield tuple(lengths), n
            if n > 1:
                yield tuple(lengths), 1

    stack: list[tuple] = [(counts, total, 0, options(counts, total, 0))]
    path: list[Pattern] = []  # the patterns that lead from a frame to the next
    while stack and budget[0] >= 0 and fewest > least:
        left, tokens, used, following = stack[-1]
        del path[len(stack) - 1 :]
        step = next(following, None)
        if step is None:
            stack.pop()
            continue
        lengths, n = step
        rest = left.copy()
        for x in lengths:
            rest[x] -= n
        tokens, used = tokens - n * sum(lengths), used + n
        path.append(step)
        if not tokens:
            if used < fewest:
                fewest, best = used, list(path)
            continue
        budget[0] -= 1
        if used + max(-(-tokens // capacity), int(rest[capacity // 2 + 1 :].sum())) < fewest and used + lower_bound(rest, capacity) < fewest:
            stack.append((rest, tokens, used, options(rest, tokens, used)))
    if fewest > least:
        LOG.warning("packed into %d sequences, lower bound %d%s", fewest, least, "" if budget[0] < 0 else ", and no packing has fewer")
    return best


def places(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length, intervals of ranks and where they go: sequence base + i // each, offset + i % each * length for the i-th of an interval."""
    rows, base, ranks = [], 0, {}
    for lengths, n in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            each = lengths.count(x)
            rows.append((x, ranks.get(x, 0), each, base, offset))
            ranks[x] = ranks.get(x, 0) + each * n
            offset += each * x
        base += n
    return pd.DataFrame(rows, columns=["length", "lo", "each", "base", "offset"])


def _salted(length: Column, key: Column, counts: np.ndarray) -> Column:
    """The part of its length that a piece is ranked in: as many parts as keep them at about RANKED pieces."""
    parts = {x: -(-int(counts[x]) // RANKED) for x in np.flatnonzero(counts > RANKED)}
    if not parts:
        return F.lit(0)
    many = F.create_map(*[F.lit(int(v)) for x in parts.items() for v in x])
    return F.pmod(key, F.coalesce(F.try_element_at(many, length.cast("int")), F.lit(1))).cast("int")


@small_batches
def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document (columns doc_id, text) and its place.

    A document is its tokens and an end, id 0; null and empty texts are the end alone. Only documents longer than a sequence
    are cut, into pieces of its capacity and a shorter last one. Sequences are filled from offset 0 without gaps. Rows that
    share a doc_id, or with a null one, are documents each. No documents: no rows. Other columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row for each length up to the capacity
        counts[r["length"]] = r["n"]
    table = places(bin_completion(counts, capacity, steps)).sort_values(["length", "lo"])
    edge = table["length"].to_numpy() * (1 << 44) + table["lo"].to_numpy()
    each, base, shift, lo = (table[c].to_numpy() for c in ("each", "base", "offset", "lo"))

    salted = cut.withColumn("salt", _salted(F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), counts))
    # a row for each length, and one more for each RANKED pieces of it
    sizes = sorted((r["length"], r["salt"], r["n"]) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    part = np.array([x << 44 | salt for x, salt, _ in sizes], np.int64)
    ranks = np.array([n for _, _, n in sizes], np.int64)
    first = np.cumsum(ranks) - ranks
    first -= np.repeat(first[np.r_[True, np.diff(part >> 44) > 0]], np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(part >> 44) > 0]), len(part)])) if len(part) else first
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            rank = b["rank"].to_numpy() - 1 + first[np.searchsorted(part, length * (1 << 44) + b["salt"].to_numpy())]
            at = np.searchsorted(edge, length * (1 << 44) + rank, side="right") - 1
            i = rank - lo[at]
            b["sequence_id"] = base[at] + i // each[at]
            b["offset"] = shift[at] + i % each[at] * length
            yield b.drop(columns=["rank", "salt"])

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("bigint"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInPandas(placed, shape)
