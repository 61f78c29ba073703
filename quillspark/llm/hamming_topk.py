"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 sign bits is cut into segments. The index maps (segment, its bits) to codes. A search step looks up one segment's
values within a radius of the query's; by the pigeonhole principle, once segments 0..j have been searched to radius r and the
others to r - 1, every code within Hamming distance m * r + j has been met. A query is done when its k-th verified distance
is no more than that, so nothing unseen can displace it; the others go on to the next step.

Codes are dealt into blocks of bounded size, each with an index of its own in a worker's memory; queries visit every block.
Values to look up are made and met there, so no table, shuffle or broadcast holds them. The first blocks are searched without
a bound; what they find bounds the search of all others. A step that would look up more values than its block has codes
compares the block's codes instead.

Equal codes are one entry, with the k + 1 smallest ids that have it: no more can be in a result, so a code that a third of
the rows share is one entry too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, setting, written
from quillspark.llm.vectors import K, QUERY_STEP, nearest, usable

BITS = 64
#: Least and most segments of a code.
SEGMENTS = (3, 8)
#: Codes of a block: its index then takes about 150 MB.
BLOCK = 1 << 21
#: Codes of a row of entries or of queries on their way to a worker, and such rows of a batch.
ENTRY_PACK, QUERY_PACK, BATCH = 4096, 256, 64
#: Values looked up, or codes met, at once.
AT_ONCE = 1 << 20


def code(vector: str = "embedding") -> Column:
    """The signs of the first 64 components as the bits of a long, first component lowest; components beyond the end are 0."""
    return F.aggregate(F.transform(F.slice(F.col(vector), 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def segments(codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, about log2(codes) wide: then a value has about one code, however many codes there are."""
    least, most = SEGMENTS
    n = max(least, min(most, round(BITS / math.log2(max(2, codes)))))
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(codes: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return ((codes >> np.uint64(at[0])) & np.uint64((1 << at[1]) - 1)).astype(np.int32)


@lru_cache(maxsize=64)
def _flips(width: int, radius: int) -> np.ndarray:
    """All masks with `radius` of `width` bits set: what is looked up at that radius."""
    return np.fromiter((sum(1 << b for b in at) for at in combinations(range(width), radius)), np.int32, math.comb(width, radius))


#: Places of queries, places of codes and their distances, one of each a pair.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Index:
    """The multi-index of a block: for each segment its codes sorted by the segment's value, and where each value begins."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.codes, self.ids, self.copies = codes.view(np.uint64), ids, copies.astype(np.int64)
        self.cut, self.tables = segments(len(codes)), []
        for at in self.cut:
            value = _segment(self.codes, at)
            starts = np.zeros((1 << at[1]) + 1, np.int32)
            np.cumsum(np.bincount(value, minlength=1 << at[1]), out=starts[1:])
            order = np.argsort(value, kind="stable").astype(np.int32)
            self.tables.append((starts, order, self.codes[order]))

    def _looked_up(self, queries: np.ndarray, at: np.ndarray, step: int, masks: np.ndarray, worst: np.ndarray) -> Iterator[Pairs]:
        """What a step meets for the queries at these places, no farther than their worst."""
        radius, seg = divmod(step, len(self.cut))
        starts, order, codes = self.tables[seg]
        values = (_segment(queries[at], self.cut[seg])[:, None] ^ masks).ravel()
        first, of = starts[values], np.repeat(at, len(masks))
        count = starts[values + 1] - first
        some = np.flatnonzero(count)
        first, of, count = first[some], of[some], count[some].astype(np.int64)
        ends = np.cumsum(count)
        low = 0
        while low < len(count):
            before = ends[low] - count[low]
            high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            n = count[low:high]
            place = np.repeat(first[low:high] - (ends[low:high] - n - before), n) + np.arange(n.sum())
            q = np.repeat(of[low:high], n)
            differ = queries[q] ^ codes[place]
            distance = np.bitwise_count(differ)
            near = np.flatnonzero(distance <= worst[q])
            q, differ, distance, place = q[near], differ[near], distance[near], place[near]
            # a code is verified once: at its first segment in the order of steps that is within reach
            fresh = np.ones(len(q), bool)
            for i, other in enumerate(self.cut):
                reach = radius if i < seg else radius - 1
                if i != seg and reach >= 0:
                    fresh &= np.bitwise_count(_segment(differ, other)) > reach
            yield q[fresh], order[place[fresh]], distance[fresh].astype(np.int64)
            low = high

    def _compared(self, queries: np.ndarray, at: np.ndarray, worst: np.ndarray) -> Iterator[Pairs]:
        """All codes of the block no farther than the queries' worst."""
        for q in at:
            distance = np.bitwise_count(self.codes ^ queries[q])
            near = np.flatnonzero(distance <= worst[q])
            yield np.full(len(near), q), near, distance[near].astype(np.int64)

    def _closest(self, found: list[Pairs], worst: np.ndarray, k: int) -> Pairs:
        """Of each query, what can be among its k nearest: the k + 1 nearest entries, ties to the smaller first id, no farther than where k + 1 ids are met. Lowers `worst` to that."""
        q, e, d = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((self.ids[e], d, q))
        q, e, d = q[by], e[by], d[by]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        length = np.diff(begins, append=len(q))
        rank = np.arange(len(q)) - np.repeat(begins, length)
        copies = self.copies[e]
        met = np.cumsum(copies) - copies
        met -= np.repeat(met[begins], length)
        last = (met <= k) & (met + copies > k)
        worst[q[last]] = np.minimum(worst[q[last]], d[last])
        keep = (rank <= k) & (d <= worst[q])
        return q[keep], e[keep], d[keep]

    def search(self, queries: np.ndarray, worst: np.ndarray, k: int) -> Pairs:
        """The entries that can be among the queries' k nearest, none of them farther than the query's worst."""
        queries, worst = queries.view(np.uint64), worst.astype(np.int64)
        empty = np.empty(0, np.int64)
        best: Pairs = (empty, empty, empty)
        for step in range(len(self.cut) * (BITS + 1)):
            radius, seg = divmod(step, len(self.cut))
            left = np.flatnonzero(worst >= step)  # all codes nearer than this have been met
            if not len(left) or radius > self.cut[seg][1]:  # or the whole segment has been searched
                break
            whole = math.comb(self.cut[seg][1], radius) > len(self.codes)
            if whole:
                done = ~np.isin(best[0], left)
                best = best[0][done], best[1][done], best[2][done]
            masks = None if whole else _flips(self.cut[seg][1], radius)
            size = max(1, AT_ONCE // (len(self.codes) if whole else len(masks)))
            for a in range(0, len(left), size):
                at = left[a : a + size]
                found = self._compared(queries, at, worst) if whole else self._looked_up(queries, at, step, masks, worst)
                for pairs in found:
                    if len(pairs[0]):
                        best = self._closest([best, pairs], worst, k)
            if whole:
                break
        return best


def _least_ids(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` smallest ids of each code, as rows. Spark limits them before its shuffle too."""
    of = Window.partitionBy("code").orderBy("id")
    return rows.withColumn("n", F.row_number().over(of)).filter(F.col("n") <= keep).drop("n")


def _packs(rows: DataFrame, parts: int, *columns: str) -> DataFrame:
    """Rows of one of so many parts as one row, each column an array in the same order."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").agg(F.collect_list(F.struct(*columns)).alias("x")).select("part", *[F.col(f"x.{c}").alias(c) for c in columns])


def _met(entries: DataFrame, asked: DataFrame, blocks: range, slices: int, k: int) -> DataFrame:
    """query, code, id, copies, distance of the entries of these blocks that can be among the queries' k nearest.

    `entries` are packs with their block, `asked` packs of queries with their worst. A task has a block and a slice of the queries.
    """
    of_entries = entries.filter(F.col("block").between(blocks[0], blocks[-1])).select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("asks"), "code", "id", "copies")
    of_queries = asked.select(F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[-1]))).alias("block"), F.pmod("part", F.lit(slices)).alias("slice"), F.lit(True).alias("asks"), "code", F.array().cast("array<bigint>").alias("id"), F.col("worst").alias("copies"))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, packs, index = None, [], None
        for b in batches:
            for block, of, asks, codes, ids, copies in zip(b["block"], b["slice"], b["asks"], b["code"], b["id"], b["copies"], strict=True):
                if key != (block, of):
                    key, packs, index = (block, of), [], None
                if not asks:
                    packs.append((codes, ids, copies))
                    continue
                if packs:
                    index, packs = Index(*(np.concatenate(x) for x in zip(*packs, strict=True))), []
                if index is not None:
                    q, e, d = index.search(codes, copies, k)
                    yield pd.DataFrame({"query": codes[q], "code": index.codes[e].view(np.int64), "id": index.ids[e], "copies": index.copies[e].astype(np.int32), "distance": d.astype(np.int32)})

    # a block's entries come before the queries that meet it
    tasks = of_entries.unionByName(of_queries).repartition("block", "slice").sortWithinPartitions("block", "slice", "asks")
    with setting(entries.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        return written(tasks.mapInPandas(searched, "query long, code long, id long, copies int, distance int"), "mih-met")


def search(rows: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding", query_step: int = QUERY_STEP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, distance (Hamming, of sign codes) of each query's k nearest, ties to the smaller id.

    Queries are the rows whose id query_step divides, candidates all rows but the query's own. Rows with a null id and
    unusable vectors (null, empty, zero, or with null or non-finite components) take no part. Rows that share an id and a
    code are one.
    """
    spark = rows.sparkSession
    fit = rows.filter(F.col(id).isNotNull() & usable(vector)).select(F.col(id).cast("bigint").alias("id"), code(vector).alias("code"))
    fit = written(fit.distinct(), "mih-codes")
    queries = fit.filter(F.col("id") % query_step == 0)
    # of what is met, as many as an id has codes can be a query's own: searches go so much deeper
    own = queries.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    deep = k + own - 1
    entries = written(_least_ids(fit, k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-entries")
    codes = written(queries.select("code").distinct(), "mih-queries")  # queries with one code have one search
    total = entries.count()
    blocks, parts = max(1, math.ceil(total / block)), max(1, math.ceil(codes.count() / QUERY_PACK))
    entry = entries.select("code", F.element_at("ids", 1).alias("id"), F.size("ids").cast("bigint").alias("copies"))
    packs = _packs(entry, blocks * max(1, math.ceil(total / blocks / ENTRY_PACK)), "code", "id", "copies")
    packs = written(packs.withColumn("block", F.pmod("part", F.lit(blocks)).cast("int")).drop("part"), "mih-index")
    # the first blocks, about the root of their number, are searched without a bound
    first = math.isqrt(blocks - 1) + 1
    tasks = 2 * spark.sparkContext.defaultParallelism
    made, met = [fit, entries, codes, packs], None
    for these in (range(first), range(first, blocks)):
        if not these:
            continue
        asked = codes.select("code", F.lit(BITS).cast("bigint").alias("worst"))
        if met is not None:  # no code farther than where enough ids have been met can be among a query's k nearest
            near = Window.partitionBy("query").orderBy("distance", "id").rowsBetween(Window.unboundedPreceding, 0)
            worst = met.withColumn("n", F.sum("copies").over(near)).filter(F.col("n") > deep).groupBy(F.col("query").alias("code")).agg(F.min("distance").cast("bigint").alias("worst"))
            asked = codes.join(worst, "code", "left").select("code", F.coalesce("worst", F.lit(BITS).cast("bigint")).alias("worst"))
        asked = written(_packs(asked, parts, "code", "worst"), "mih-asked")
        found = _met(packs, asked, these, min(parts, math.ceil(tasks / len(these))), deep)
        made += [asked, found]
        met = found if met is None else met.unionByName(found)
    result = written(_closest(met, deep), "mih-nearest")
    made.append(result)
    of_query = result.join(entries, "code").select("query", "ids", "distance")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(of_query, "query").select("query_id", F.explode("ids").alias("vec_id"), "distance").filter(F.col("vec_id") != F.col("query_id"))
    out = written(nearest(pairs, k, "distance").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance"), "mih-result")
    for x in made:
        discard(x)
    return out


def _closest(met: DataFrame, k: int) -> DataFrame:
    """Of each query, the k + 1 nearest entries, ties to the smaller first id. Each has an id at least, so no other can hold one of the k nearest."""
    near = Window.partitionBy("query").orderBy("distance", "id")
    return met.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1).select("query", "code", "distance")


#: DuckDB SQL for search() of the embeddings.
SQL = """
with fit as (
  select vec_id, list_sum([case when embedding[i] > 0 then (1::hugeint << (i - 1)::hugeint) else 0::hugeint end for i in range(1, 65)])::uhugeint as code
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, bit_count(xor(q.code, c.code)::bit)::int as distance
  from fit q join fit c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, distance from ranked where rank <= 10
"""
