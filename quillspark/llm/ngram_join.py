"""Exact Jaccard self-join of documents' word shingles by universe partition.

Sets are dealt into bands by size, so that a set's partners are in its own band or the one below. A band cuts the universe
of hashed shingles into m segments. Two sets of sizes x <= y with Jaccard similarity t or more differ in at most
H = (1 - t) / (1 + t) * (x + y) shingles. The larger set allots v = 0, 1 or 2 to each segment with a sum above H: by the
pigeonhole principle some segment differs in at most v - 1 shingles. v = 1 looks up the segment's whole subset, v = 2 also its
one-deletion neighbourhood, against which the smaller set's subset and neighbourhood are indexed. The allocation is by cost:
empty segments and subsets that other sets of the same batch share are skipped first, then those with few shingles, and
deletions are used only as far as needed, smallest neighbourhoods first.

A set whose shingles fall into few segments can't reach the sum: it is cut once more with another seed, and again until the
sum is reached. If that of a larger set falls short by some, a partner that it hasn't met has few shingles outside its
segments, so it fills few segments too: only such sets are indexed with the next seed, one in thousands each time.

Signatures don't travel as rows: a mapper sorts those of a batch of documents into one binary block per bucket, and a bucket
finds equal signatures by sorting arrays. Sets are known by a 64-bit digest, so exact copies are one set from the mapper on.

Candidates that sizes and small sketches of the sets can't rule out are verified exactly on the whole sets. What is wanted is
components, so each set's pair with its smallest partner goes first, and other pairs are verified only if their ends are not
yet in one component. A bucket with many sets sends its members, dealt into blocks; a forest of hopeful pairs connects those of
a block, then one member stands for each component that a block has, and members of different blocks meet only in buckets
that these steps leave in several components. Other pairs of a block follow where its forest fails.

Links are all inside components, so they are counted there: every set of a component meets every other in one tile, where
an index of shingles gives all intersections exactly. Counts per set are sent, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, claim, discard, partitions, small, small_batches, written
from quillspark.llm.components import components

WORDS = 5
#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Shingles that a mapper gathers before it sends blocks.
BATCH = 1 << 19
#: Sets in a bucket up to which all its pairs are candidates at once.
SMALL = 8
#: Least bits of a set's sketch, a power of two; larger sets have two bits a shingle or more.
SKETCH = 1024
#: Members of a bucket that are compared in one block.
BLOCK = 2048
#: Sets of a component that are compared in one block, and bytes of their shingles: about so many on average.
LINK_BLOCK, LINK_BYTES = 2048, 8 << 20
#: Entries of an index of shingles that are looked up at once.
POSTINGS = 1 << 20

INDEX, PROBE, PROBE_CUTS, CUT_INDEX, CUT_PROBE = 1, 2, 4, 8, 16


_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Powers of the base and of its inverse modulo 2**64, as far as the longest text so far needs.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of a text that are hashed together; longer ones are cut at white space.
CHUNK = 1 << 20


def _powers(size: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < size:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * max(size, 4096), base, np.uint64))])
    return _POWERS


def _forget_powers() -> None:
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _word_hashes(raw: bytes) -> np.ndarray:
    """Of each word a polynomial of its bytes, from running sums over the whole text: the same wherever the word stands."""
    b = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~_SPACE[b]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return _mixed((total[end] - total[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """A-Z are lower-cased, and words are runs of anything but ASCII white space."""
    raw, parts, at = (text or "").encode().lower(), [np.empty(0, np.uint64)], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; with fewer words, of the whole sequence; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out += h[i : len(h) - width + 1 + i] * _MULT[i % len(_MULT)] if i < len(_MULT) else _mixed(h[i : len(h) - width + 1 + i] + np.uint64(i))
    return np.unique(_mixed(out))


class Bands:
    """Size bands and their segments, up to the band of the largest size."""

    def __init__(self, largest: int, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.lo = [1]
        while self.lo[-1] <= largest:
            self.lo.append(max(self.lo[-1] + 1, -(-self.lo[-1] * den // num)))
        self.lo = np.array(self.lo)
        most = self.lo[1:] - 1  # largest size of each band
        need = self.needed(most, most * den // num)
        # few segments are all cut; of many, so many that empty ones are made up for: allocations fall short about never
        few = most <= 32
        self.segments = np.where(few, -(-need * 3 // 4) + (need > 4), need + 4 + need // 25)
        self.cuts = np.where(few, self.segments, np.where(most <= 128, 8, 3))  # the first segments have their deletions indexed
        self.most = most
        self.few = few

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, sizes, side="right") - 1

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One more than the most shingles in which linked sets of at most these sizes differ."""
        return (self.den - self.num) * (x + y) // (self.den + self.num) + 1


def _ranks(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Each row's place in its group, ordered by keys."""
    order = np.lexsort((*reversed(keys), group))
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
    start = np.flatnonzero(first)
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return out


#: Seeds of the cuts. Few sets come to the second; none is thinkable that comes to the last.
SEEDS = 64


def allotted(flat: np.ndarray, sizes: np.ndarray, bands: Bands, below: bool, seed: int = 0) -> dict:
    """How sets (their shingles in one array) are cut and looked up in their own band, or in the one below."""
    own = bands.of(sizes)
    band = own - below
    ok = (sizes > 0) & (band >= 0)
    band = np.where(ok, band, 0)
    m = np.where(ok, bands.segments[band], 0)
    base = np.r_[0, np.cumsum(m)]
    doc = np.repeat(np.arange(len(sizes)), np.where(ok, sizes, 0))
    token = flat if ok.all() else flat[np.repeat(ok, sizes)]
    dealt = token  # in rising order, so a segment's shingles stand together
    if seed:
        dealt = _mixed(token ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        order = np.lexsort((dealt, doc))
        token, dealt = token[order], dealt[order]
    at = base[doc] + ((dealt >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(at, minlength=base[-1])
    owner = np.repeat(np.arange(len(sizes)), m)
    segment = np.arange(base[-1]) - base[owner]
    need = np.where(ok, bands.needed(np.minimum(sizes, bands.most[band]), sizes), 0)
    full = np.flatnonzero(count)
    short = need - np.bincount(owner[full], minlength=len(sizes))
    cuttable = np.flatnonzero((count > 1) & (segment < bands.cuts[band][owner]) & (short[owner] > 0))
    cut = np.zeros(len(count), bool)
    cut[cuttable[_ranks(owner[cuttable], count[cuttable]) < short[owner[cuttable]]]] = True
    filled = np.bincount(owner[full], minlength=len(sizes))
    weak = short > np.bincount(owner[cuttable], minlength=len(sizes))
    # what a larger set that falls short allots and this one's shingles beside its segments are at most the shingles in which
    # they differ: so many segments this one fills, less one where all are cut, as the larger allots 2 to one at least
    crowded = ok & (filled <= bands.needed(sizes, sizes * bands.den // bands.num) - 1 - bands.few[band])
    out = {"weak": weak, "crowded": crowded, "band": band, "ok": ok}
    scrambled = _mixed(token + np.uint64(1))
    total = np.r_[np.uint64(0), np.cumsum(scrambled)]
    end = np.cumsum(count)
    subset = total[end] - total[end - count]
    salt = _mixed((band[owner].astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(7) + np.uint64(seed << 26))
    exact = _mixed(subset + salt)
    _, back, often = np.unique(exact[full], return_inverse=True, return_counts=True)
    probe = np.zeros(len(count), bool)
    probe[full[_ranks(owner[full], often[back], -count[full]) < need[owner[full]]]] = True
    return out | {"at": at, "doc": doc, "owner": owner, "count": count, "full": full, "cut": cut, "probe": probe, "exact": exact, "subset": subset, "salt": salt, "scrambled": scrambled, "indexed_cut": (segment < bands.cuts[band][owner]) & (count > 1)}


def signatures(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of some sets: hash, set id, flags."""
    parts = []
    for below in (False, True):
        f, n, who = flat, sizes, ids
        probing, indexing = np.ones(len(n), bool), np.full(len(n), not below)
        for seed in range(SEEDS):
            a = allotted(f, n, bands, below, seed=seed)
            asks, has = probing[a["owner"]], indexing[a["owner"]]
            flags = np.where(a["probe"] & asks, PROBE, 0) | np.where(a["cut"] & asks, PROBE | PROBE_CUTS, 0) | np.where(has, INDEX, 0)
            keep = a["full"][flags[a["full"]] > 0]
            parts.append((a["exact"][keep], who[a["owner"][keep]], flags[keep]))
            asked, held = a["cut"] & asks, a["indexed_cut"] & has
            t = np.flatnonzero((asked | held)[a["at"]])
            s = a["at"][t]
            less = _mixed(a["subset"][s] - a["scrambled"][t] + a["salt"][s])
            parts.append((less, who[a["owner"][s]], np.where(asked[s], CUT_PROBE, 0) | np.where(held[s], CUT_INDEX, 0)))
            probing, indexing = probing & a["weak"], indexing & a["crowded"]
            more = probing | indexing
            if not more.any():
                break
            f, n, who, probing, indexing = f[np.repeat(more, n)], n[more], who[more], probing[more], indexing[more]
        else:
            raise ValueError("a set's shingles fall into few segments whatever the seed")
    return tuple(np.concatenate([p[i] for p in parts]).astype(kind) for i, kind in enumerate((np.uint64, np.uint64, np.uint8)))


def sketch(s: np.ndarray) -> bytes:
    """For each of some buckets of shingles, whether their number is odd. Sets differ in as many shingles as their sketches in bits, or more."""
    size = max(SKETCH, 2 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _bits(sketches: pd.Series, length: int) -> np.ndarray:
    """Sketches as rows of words, folded to `length` bytes: buckets that fall together add up, and so do their parities."""
    out = np.empty((len(sketches), length // 8), np.uint64)
    for i, x in enumerate(sketches):
        v = np.frombuffer(x, np.uint64)
        while len(v) > length // 8:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def _possible(x: np.ndarray, y: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes x and y that differ in so many shingles at least can be linked."""
    both = (x + y - differ) // 2
    return (den * both >= num * (x + y - both)) & (den * np.minimum(x, y) >= num * np.maximum(x, y))


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[tuple[list, list]]:
    """Groups of documents: their ids, and their sets."""
    claim("shingles", _forget_powers)
    ids, sets, held = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            ids.append(i)
            sets.append(s := shingles(t, words))
            held += len(s) + 8
            if held >= BATCH:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


#: No set is larger than this: a text has fewer than 2**31 bytes.
LARGEST = 1 << 30


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _wanted() -> np.ndarray:
    f = np.arange(32)
    return (np.where(f & (PROBE | CUT_PROBE), INDEX, 0) | np.where(f & PROBE_CUTS, CUT_INDEX, 0)).astype(np.uint8)


def matched(key: np.ndarray, ids: np.ndarray, flags: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (two arrays) of keys with `small` sets at most, and the members (key, id) of the others."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    twin = np.r_[False, k[1:] == k[:-1]]
    order = order[twin | np.r_[twin[1:], False]]
    order = order[np.lexsort((ids[order], key[order]))]
    k, s, f = key[order], ids[order], flags[order]
    if not len(k):
        return s, s, k, s
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    k, s, f = k[first], s[first], np.bitwise_or.reduceat(f, first)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    head, length = np.repeat(start, size), np.repeat(size, size)
    wanted = _wanted()
    left, right = [], []
    for off in range(1, small):
        i = np.flatnonzero((length[:-off] <= small) & (head[:-off] == head[off:])) if off < len(k) else np.empty(0, np.int64)
        i = i[((wanted[f[i]] & f[i + off]) | (wanted[f[i + off]] & f[i])) > 0]
        left.append(s[i])
        right.append(s[i + off])
    # of a crowded key only members that some other's flags ask for, or that ask for some other's
    has, asks = (np.repeat(np.bitwise_or.reduceat(x, start), size) for x in (f, wanted[f]))
    members = np.flatnonzero((length > small) & (((wanted[f] & has) | (f & asks)) > 0))
    return np.concatenate(left), np.concatenate(right), k[members], s[members]


def _candidates(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Rows (kind, a, b, n): kind 0: sets a and b agree in n signatures of a bucket; kind 1: key a has set b, with many others."""
    buckets = partitions(docs.sparkSession)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, sets in _sets(batches, words):
            unique = {_digest(s): s for s in sets if len(s)}
            if not unique:
                continue
            ids, held = np.fromiter(unique, np.uint64, len(unique)), list(unique.values())
            sig, owner, flags = signatures(np.concatenate(held), np.array([len(s) for s in held]), ids, bands)
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            sig, owner, flags = sig[order].astype(np.uint32), owner[order], flags[order]
            full = np.flatnonzero(np.diff(edges))
            cut = [slice(edges[i], edges[i + 1]) for i in full]
            yield pd.DataFrame({"bucket": full.astype(np.int32), "sigs": [sig[c].tobytes() for c in cut], "owners": [owner[c].tobytes() for c in cut], "flags": [flags[c].tobytes() for c in cut]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, list] = {}
        for b in batches:
            for n, *x in b.itertuples(index=False):
                parts.setdefault(n, []).append(x)
        for n, p in parts.items():
            key, owner, flags = (np.concatenate([np.frombuffer(x[i], kind) for x in p]) for i, kind in enumerate((np.uint32, np.uint64, np.uint8)))
            left, right, of, member = matched(key, owner, flags)
            a, b = np.minimum(left, right), np.maximum(left, right)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
            yield pd.DataFrame({"kind": np.zeros(len(first), np.int32), "a": _signed(a[first]), "b": _signed(b[first]), "n": np.diff(np.r_[first, len(a)]).astype(np.int32)})
            yield pd.DataFrame({"kind": np.ones(len(of), np.int32), "a": (np.int64(n) << 32) + of.astype(np.int64), "b": _signed(member), "n": np.ones(len(of), np.int32)})

    sent = docs.select("doc_id", "text").mapInPandas(blocks, "bucket int, sigs binary, owners binary, flags binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInPandas(meet, "kind int, a long, b long, n int")


def _known(docs: DataFrame, words: int) -> DataFrame:
    """Each document's set: doc_id, n_shingles, set (its digest, null if empty), sketch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in _sets(batches, words):
            sizes = np.array([len(s) for s in sets])
            digest = pd.array([None if not len(s) else int(_signed(np.uint64(_digest(s)))) for s in sets], dtype="Int64")
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_shingles": sizes.astype(np.int64), "set": digest, "sketch": [sketch(s) for s in sets]})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_shingles long, set long, sketch binary")


def _whole(docs: DataFrame, known: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set, shingles) of the wanted sets, computed anew from one document of each."""
    first = known.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("_first")).join(wanted, "set").select("_first").distinct()
    first = written(first, "join-first")
    small = first.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(first) if small else first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, sets in _sets(batches, words):
            full = [s for s in sets if len(s)]
            yield pd.DataFrame({"set": _signed(np.array([_digest(s) for s in full], np.uint64)), "shingles": [s.tobytes() for s in full]})

    return texts.mapInPandas(rows, "set long, shingles binary").dropDuplicates(["set"])


def _hopeful(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, other columns) that sizes and sketches don't rule out."""
    columns = pairs.columns
    both = pairs.join(sets.toDF("a", "x", "left"), "a").join(sets.toDF("b", "y", "right"), "b").filter(F.greatest("x", "y") * num <= F.least("x", "y") * den)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            length = np.minimum(t["left"].map(len), t["right"].map(len)).to_numpy()
            differ = np.zeros(len(t), np.int64)
            for n in np.unique(length):
                at = length == n
                differ[at] = np.bitwise_count(_bits(t.loc[at, "left"], n) ^ _bits(t.loc[at, "right"], n)).sum(axis=1, dtype=np.int64)
            yield t.loc[_possible(t["x"].to_numpy(), t["y"].to_numpy(), differ, num, den), columns]

    return both.select(*columns, "x", "y", "left", "right").mapInPandas(kept, pairs.schema)


def _spanning(root: np.ndarray, size: np.ndarray, ids: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[list, list]:
    """Hopeful pairs that connect what all hopeful pairs connect, members of one root being connected already. Members are in order of ids.

    A search from member to member that compares with those not reached yet: where all are alike, one pass reaches them all.
    """
    left, right, new = [], [], np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not new[start]:
            continue
        same = root == root[start]
        new &= ~same
        reached = list(np.flatnonzero(same))
        while reached:
            at = reached.pop()
            rest = np.flatnonzero(new)
            if not len(rest):
                break
            hit = rest[_possible(size[at], size[rest], np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64), num, den)]
            if len(hit):
                roots, first = np.unique(root[hit], return_index=True)
                left += [ids[at]] * len(first)
                right += list(ids[hit[first]])
                more = np.flatnonzero(new & np.isin(root, roots))
                new[more] = False
                reached += list(more)
    return left, right


def _every(root: np.ndarray, size: np.ndarray, ids: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[list, list]:
    """All hopeful pairs of members of different roots."""
    left, right = [], []
    for at in range(len(ids) - 1):
        rest = at + 1 + np.flatnonzero(root[at + 1 :] != root[at])
        hit = rest[_possible(size[at], size[rest], np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64), num, den)]
        left += [ids[at]] * len(hit)
        right += list(ids[hit])
    return left, right


def _across(members: DataFrame, num: int, den: int, every: bool, inside: bool = False) -> DataFrame:
    """Pairs (key, a, b) of members (key, set, root, size, sketch) of one key and different roots that sizes and sketches don't rule out: every one, or as many as connect them.

    A key's members are dealt into blocks, and a task compares two blocks, or with `inside` the members of one: no pair
    becomes a row unless it is asked for.
    """
    number = members.groupBy("key").agg((F.count("*") / BLOCK).cast("int").alias("more")).filter("more > 0")
    if inside:
        dealt = members.join(number, "key", "left").withColumn("lo", F.pmod(F.xxhash64("set"), F.coalesce("more", F.lit(0)) + 1).cast("int"))
        tiles = dealt.select("key", "lo", F.col("lo").alias("hi"), "set", "root", "size", "sketch")
    elif number.isEmpty():
        tiles = members.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "set", "root", "size", "sketch")
    else:
        dealt = members.join(number, "key", "left").withColumn("blocks", F.coalesce("more", F.lit(0)) + 1).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        tiles = dealt.select("key", "set", "root", "size", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "root", "size", "sketch")
    tile = ["key", "lo", "hi"]
    pick = _every if every else _spanning

    def compared(t: pd.DataFrame) -> pd.DataFrame:
        left, right = pick(t["root"].to_numpy(), t["size"].to_numpy(), t["set"].to_numpy(), _bits(t["sketch"], min(map(len, t["sketch"]))), num, den)
        return pd.DataFrame({"key": np.full(len(left), t["key"].iloc[0], np.int64), "a": np.minimum(left, right).astype(np.int64), "b": np.maximum(left, right).astype(np.int64)})

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            t = b if rest is None else pd.concat([rest, b], ignore_index=True)
            names = t[tile].to_numpy()
            starts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1]
            out = [compared(t.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            rest = t.iloc[starts[-1] :]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest):
            yield compared(rest)

    return tiles.repartition(*tile).sortWithinPartitions(*tile, "set").mapInPandas(groups, "key long, a long, b long")


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    both = pairs.select("a", "b").join(whole.select(F.col("set").alias("a"), F.col("shingles").alias("left")), "a").join(whole.select(F.col("set").alias("b"), F.col("shingles").alias("right")), "b")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            keep = []
            for left, right in zip(t["left"], t["right"], strict=True):
                both = np.sort(np.concatenate([np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)]), kind="stable")
                same = np.count_nonzero(both[1:] == both[:-1])
                keep.append(den * same >= num * (len(both) - same))
            yield t.loc[keep, ["a", "b"]]

    return both.select("a", "b", "left", "right").mapInPandas(compared, "a long, b long")


def linked_with(sets: list[np.ndarray], block: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of each set (sorted distinct shingles) the number of others that it links with: of all, or if there are two blocks, of the other block."""
    size = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    two = bool((block != block[0]).any())
    probing = np.flatnonzero(block == block[0])
    indexed = block[owner] != block[0] if two else np.ones(len(owner), bool)
    order = np.flatnonzero(indexed)[np.argsort(token[indexed], kind="stable")]
    postings = owner[order]
    edge = np.searchsorted(token[order], np.arange(token.max() + 2))
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(len(sets), np.int64)
    for i in probing:
        mine = token[at[i] : at[i + 1]]
        first, count = edge[mine], edge[mine + 1] - edge[mine]
        both = np.zeros(len(sets), np.int64)
        part = np.cumsum(count) // POSTINGS
        for n in range(part[-1] + 1) if part[-1] else [None]:
            f, c = (first, count) if n is None else (first[part == n], count[part == n])
            places = np.repeat(f - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum()) if len(c) else np.empty(0, np.int64)
            both += np.bincount(postings[places], minlength=len(sets))
        link = (both > 0) & (den * both >= num * (size[i] + size - both))
        link[i] = False
        out[i] += np.count_nonzero(link)
        if two:
            out += link
    return out


def _link_counts(roots: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """set, n_links (other sets that it links with) of the sets that are in components. whole: set, shingles."""
    members = roots.select(F.col("node").alias("set"), "root").join(whole, "set")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / LINK_BLOCK), F.ceil(F.sum(F.length("shingles")) / LINK_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    tile = ["root", "lo", "hi"]
    tiles = dealt.select("root", "set", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "block", "shingles")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def compared(t: pd.DataFrame) -> pd.DataFrame:
            block = t["block"].to_numpy()
            if t["lo"].iloc[0] != t["hi"].iloc[0] and (block == block[0]).all():
                n = np.zeros(len(t), np.int64)  # nothing is dealt to the other block
            else:
                n = linked_with([np.frombuffer(x, np.uint64) for x in t["shingles"]], block, num, den)
            return pd.DataFrame({"set": t["set"].to_numpy(), "n": n})

        for b in batches:
            t = b if rest is None else pd.concat([rest, b], ignore_index=True)
            names = t[tile].to_numpy()
            starts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1]
            out = [compared(t.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            rest = t.iloc[starts[-1] :]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest):
            yield compared(rest)

    dealt_out = tiles.repartition(*tile).sortWithinPartitions(*tile, "set").mapInPandas(counted, "set long, n long")
    return dealt_out.groupBy("set").agg(F.sum("n").alias("n_links"))


@small_batches
def similar(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document (columns doc_id, text).

    A document's set: the distinct shingles of `words` words of its whole text (fewer words: the whole sequence; none: empty).
    Sets link when den * intersection >= num * union; empty sets link with nothing. component_id is the smallest doc_id that
    links reach, the document's own included. Null texts are empty. Rows with a null doc_id have a row and hand links on, but
    give no id: component_id is null where no reachable row has one. Other columns are ignored. n_links is the number of
    other sets that a document's set links with, copies being one set; without count_links the column is left out.
    Shingles and sets are compared by 64-bit hashes.
    """
    bands = Bands(LARGEST, num, den)
    known = written(_known(docs, words), "join-known")
    found = written(_candidates(docs, words, bands), "join-found")
    pairs = found.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    members = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("set")).distinct()
    sets = written(known.filter("set is not null").groupBy("set").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")), "join-sets")
    pairs, members = written(_hopeful(pairs, sets, num, den), "join-pairs"), written(members, "join-members")
    discard(found)

    def linked(p: DataFrame) -> DataFrame:
        whole = written(_whole(docs, known, p.select(F.col("a").alias("set")).union(p.select("b")).distinct(), words), "join-whole")
        out = written(_verified(p, whole, num, den), "join-links")
        discard(whole)
        return out

    crowded = not members.isEmpty()

    def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Members with their roots, of buckets that are in several components so far."""
        at = small(roots)
        rooted = rows.join(at, rows["set"] == at["node"], "left").select("key", "set", F.coalesce("root", "set").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        return rooted.join(several, "key", "left_semi")

    def among(rows: DataFrame, every: bool) -> DataFrame:
        """Pairs of members of one bucket that are in different components so far."""
        return _across(written(rows, "join-mixed").join(sets, "set"), num, den, every).select("a", "b")

    def apart(p: DataFrame, roots: DataFrame) -> DataFrame:
        at, columns = small(roots), p.columns
        for end in ("a", "b"):
            p = p.join(at.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return p.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(columns)

    # hopeful pairs that connect what all hopeful pairs connect: those of small buckets, and a forest in each block of a crowded one
    edges = written(_across(members.withColumn("root", F.col("set")).join(sets, "set"), num, den, False, True), "join-edges") if crowded else None
    hopeful = pairs.select("a", "b")
    hopeful = written((hopeful.union(edges.select("a", "b")) if crowded else hopeful).distinct(), "join-hopeful")
    # each set's pair with its smallest partner is verified first, then those that are still apart
    ends = hopeful.select(F.col("a").alias("x"), F.col("b").alias("y")).union(hopeful.select("b", "a"))
    tried = written(ends.groupBy("x").agg(F.min("y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "join-tried")
    links = linked(tried)
    roots = components(links)

    def more_links(rest: DataFrame) -> bool:
        """Verify what wasn't yet; whether components grew."""
        nonlocal tried, links, roots
        rest = written(rest.distinct().join(tried, ["a", "b"], "left_anti"), "join-rest")
        if rest.isEmpty():
            return False
        found = linked(rest)
        tried = written(tried.unionByName(rest), "join-tried")
        if found.isEmpty():
            return False
        links = written(links.unionByName(found), "join-links")
        roots = components(links)
        return True

    more_links(apart(hopeful, roots))
    if crowded:
        large = written(members.groupBy("key").count().filter(F.col("count") >= BLOCK).select("key"), "join-large")  # buckets of several blocks
        if not large.isEmpty():
            dealt = written(members.join(large, "key", "left_semi"), "join-dealt")
            while more_links(among(mixed(dealt, roots).groupBy("key", "root").agg(F.min("set").alias("set")), False)):
                pass
        # a block whose forest is linked has nothing left to try; elsewhere what failed to connect may do so by other pairs: by
        # as few as would, again and again, and when those are used up by every one
        failed = written(apart(edges, roots).select("key").union(large).distinct(), "join-failed")
        if not failed.isEmpty():
            members = written(members.join(failed, "key", "left_semi"), "join-members")
            while more_links(among(mixed(members, roots), False)):
                pass
            more_links(among(mixed(members, roots), True))

    least = known.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("first")).join(roots, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "first")
    of_root = least.groupBy("root").agg(F.min("first").alias("component_id"))
    names = least.join(of_root, "root").select("set", "component_id")
    out = known.join(names, "set", "left")
    columns = ["doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if not count_links:
        return out.select(*columns)
    whole = written(_whole(docs, known, roots.select(F.col("node").alias("set")), words), "join-whole")
    counts = written(_link_counts(roots, whole, num, den), "join-counts")
    discard(whole)
    return out.join(counts, "set", "left").select(*columns, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
