"""Nearest neighbours by a block matrix join of int8 tiles with exact refinement.

Queries and candidates are dealt into blocks by a hash of their ids. Each (query block, candidate block) tile is one row of a
join on block numbers: the stated query set against all rows, in blocks of bounded size. Blocks travel as int8 codes with a
scale and a quantisation error a vector, an eighth of their floats. A tile multiplies the codes; from
the product and each vector's quantisation error it has a lower and an upper bound of every distance (triangle inequality).
Pairs whose lower bound is beyond the query's k-th least upper bound, of the tile and then of all tiles, can't be among its k
nearest; of the others the floats are fetched, distances are computed anew in float64 and heaps keep the k best. So results
are exact, not approximate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small, written
from quillspark.llm.vectors import K, QUERY_STEP, nearest, usable

#: Rows of a block: a tile's float32 product then takes 16 MB.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
LEVELS = 127


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each row's scale, and an upper bound of the distance between row and code * scale."""
    scale = np.abs(x).max(axis=1, keepdims=True) / LEVELS
    codes = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - codes * scale) ** 2).sum(axis=1))
    return codes, scale[:, 0], error * (1 + 1e-9) + 1e-300


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def tile(qi: np.ndarray, q: Quantised, ci: np.ndarray, c: Quantised, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of the tile the candidates that can be among its k nearest of them: (query's place, candidates' places, lower and upper bounds of distances). A query's own id is no candidate."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    # products of int8 codes are sums of integers below 2**24 for up to 1040 dimensions: exact in float32
    kind = np.float32 if qc.shape[1] * LEVELS * LEVELS < 2**24 else np.float64
    dot = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    qn, cn = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2, (cc.astype(np.float64) ** 2).sum(axis=1) * cs**2
    squared = np.maximum(qn[:, None] + cn[None, :] - 2 * dot * qs[:, None] * cs[None, :], 0)
    slack = 1e-12 * (qn[:, None] + cn[None, :])  # of rounding in this line and the one above
    error = qe[:, None] + ce[None, :]
    low, high = np.sqrt(np.maximum(squared - slack, 0)) - error, np.sqrt(squared + slack) + error
    own = qi[:, None] == ci[None, :]
    low[own] = high[own] = np.inf
    least = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ci) > k else np.full(len(qi), np.inf)
    for r in range(len(qi)):
        at = np.flatnonzero((low[r] <= least[r]) & ~own[r])
        if len(at):
            yield r, at, low[r, at], high[r, at]


def _blocks(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """Blocks of rows (id, key, v): their ids and keys, int8 codes, scales and errors as bytes. No float of a vector travels."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition is dealt by block, so its rows of one block may come in several batches; each makes a part of the block
        for b in batches:
            for (n, dims), x in b.groupby([name, "dims"]):
                codes, scale, error = quantised(np.stack(x["v"].tolist()).astype(np.float64))
                parts = {"ids": x["id"].to_numpy(np.int64), "keys": x["key"].to_numpy(np.int64), "codes": codes, "scales": scale, "errors": error}
                yield pd.DataFrame({name: [n], "dims": [dims], **{f"{name}_{k}": [v.tobytes()] for k, v in parts.items()}})

    dealt = rows.withColumn(name, F.pmod("key", F.lit(blocks)).cast("int")).withColumn("dims", F.size("v"))
    dealt = dealt.repartition(name).sortWithinPartitions(name, "dims")
    return dealt.select(name, "id", "key", "v", "dims").mapInPandas(packed, f"{name} int, dims int, " + ", ".join(f"{name}_{k} binary" for k in ("ids", "keys", "codes", "scales", "errors")))


def _unpacked(r: pd.Series, name: str) -> tuple[np.ndarray, np.ndarray, Quantised]:
    ids, keys, scales, errors = (np.frombuffer(r[f"{name}_{k}"], kind) for k, kind in (("ids", np.int64), ("keys", np.int64), ("scales", np.float64), ("errors", np.float64)))
    return ids, keys, (np.frombuffer(r[f"{name}_codes"], np.int8).reshape(len(ids), -1), scales, errors)


def _measured(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, copies, score of pairs (query_id, vec_id, copies, q, c): distances of the vectors themselves. A heap keeps each query's k best of a batch."""

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heaps: dict[int, list] = {}
            for query, i, copies, q, c in zip(b["query_id"], b["vec_id"], b["copies"], b["q"], b["c"], strict=True):
                d = float(np.sqrt(((np.asarray(c, np.float64) - np.asarray(q, np.float64)) ** 2).sum()))
                heaps.setdefault(query, []).append((d, i, copies))
            rows = [(query, i, copies, d) for query, found in heaps.items() for d, i, copies in heapq.nsmallest(k, found)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "copies", "score"])

    return pairs.select("query_id", "vec_id", "copies", "q", "c").mapInPandas(distances, "query_id long, vec_id long, copies int, score double")


def search(rows: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding", query_step: int = QUERY_STEP, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of each query's k nearest, ties to the smaller id.

    Queries are the rows whose id query_step divides, candidates all rows but the query's own. Rows with a null id and
    vectors that are null, empty or zero or hold null or non-finite components take no part; vectors meet only those of
    their own length. A query without candidates has no row. Rows with the same id are candidates each, and equal ones one
    query. Equal rows are one row with a number of copies until the end.
    """
    spark = rows.sparkSession
    fit = rows.filter(F.col(id).isNotNull() & usable(vector)).select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fit = fit.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")).withColumn("key", F.xxhash64("id", "v"))
    fit = written(fit, "ann-rows")
    queries = fit.filter(F.col("id") % query_step == 0)
    n, m = fit.count(), queries.count()
    # every query block is needed beside every candidate block: the pairs of block numbers are the tiles
    of_q, of_c = max(1, math.ceil(m / query_block)), max(1, math.ceil(n / candidate_block))
    tiles = spark.range(of_c).select(F.col("id").cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(of_q - 1))).alias("qb"))
    q, c = written(_blocks(queries, "qb", of_q), "ann-queries"), written(_blocks(fit, "cb", of_c), "ann-candidates")
    joined = tiles.join(c, "cb").join(q, ["qb", "dims"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                (qi, qk, qq), (ci, ck, cq) = _unpacked(r, "qb"), _unpacked(r, "cb")
                found = [(np.full(len(at), x), at, low, high) for x, at, low, high in tile(qi, qq, ci, cq, k)]
                if found:
                    x, at, low, high = map(np.concatenate, zip(*found, strict=True))
                    yield pd.DataFrame({"query_id": qi[x], "query_key": qk[x], "vec_id": ci[at], "vec_key": ck[at], "low": low, "high": high})

    met = written(joined.mapInPandas(products, "query_id long, query_key long, vec_id long, vec_key long, low double, high double"), "ann-met")
    # over all tiles too, what is certainly farther than the k-th upper bound is out
    nearest_high = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("high"))).filter(F.col("_n") == k).select("query_id", "query_key", F.col("high").alias("bound"))
    left = written(met.join(nearest_high, ["query_id", "query_key"], "left").filter(F.col("bound").isNull() | (F.col("low") <= F.col("bound"))).drop("bound", "low", "high"), "ann-left")
    # floats are fetched for survivors only: by a broadcast of their keys while these are few
    wanted = small(written(left.select(F.col("vec_id").alias("id"), F.col("vec_key").alias("key")).distinct(), "ann-wanted"))
    floats = fit.join(wanted, ["id", "key"], "left_semi").select(F.col("id").alias("vec_id"), F.col("key").alias("vec_key"), "copies", F.col("v").alias("c"))
    pairs = left.join(floats, ["vec_id", "vec_key"]).join(queries.select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), F.col("v").alias("q")), ["query_id", "query_key"])
    exact = _measured(pairs, k).select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    out = written(nearest(exact, k, "score").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann-result")
    for x in (fit, q, c, met, left):
        discard(x)
    return out


#: DuckDB SQL for search() of the embeddings.
SQL = """
with fit as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_distance(q.v, c.v) as score
  from fit q join fit c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""
