"""Searches over vectors and codes, and the pipeline."""

import math
from collections import Counter

import numpy as np

import corpus_pipeline
from quillspark.llm import block_ann, hamming_topk, queries


def table(spark, seed, n, dims=64, copies=40):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims)).astype(np.float32)
    v[::7] = v[0]  # a very common vector
    v[1] = 0
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None] + [0.0] * (dims - 2), 1), (n + 3, [math.nan] * dims, 1), (n + 4, [math.inf] + [0.0] * (dims - 1), 1), (None, [1.0] * dims, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), {i: v[i].astype(np.float64) for i in range(n) if v[i].any()}


def test_block_search_is_exact(spark):
    df, v = table(spark, 1, 700)
    got = block_ann.search(df, query_block=3, candidate_block=100).collect()
    want = []
    for q in (i for i in v if i % 100 == 0):
        d = sorted((math.sqrt(((v[i] - v[q]) ** 2).sum()), i) for i in v if i != q)[:10]
        want += [(q, n, i) for n, (_, i) in enumerate(d, 1)]
        for r in got:
            if r.query_id == q:
                assert abs(r.score - d[r["rank"] - 1][0]) < 1e-9
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_few_candidates_and_none(spark):
    df, v = table(spark, 2, 5)
    assert sorted((r.query_id, r["rank"]) for r in block_ann.search(df).collect()) == [(0, 1), (0, 2), (0, 3)]
    assert sorted((r.query_id, r["rank"]) for r in hamming_topk.search(df).collect()) == [(0, 1), (0, 2), (0, 3)]
    for f in (block_ann.search, hamming_topk.search):
        assert f(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in block_ann.search(twice).collect()] == [(0, 1)]
    assert {(r.query_id, r.vec_id) for r in hamming_topk.search(twice).collect()} == {(0, 1), (0, 2)}


def test_bounds_hold():
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 33)) * r.uniform(1e-3, 1e3, (50, 1))
    codes, scale, error = block_ann.quantised(x)
    assert (np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) <= error).all()


def test_hamming_is_exact(spark):
    df, v = table(spark, 4, 900)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in hamming_topk.search(df).collect())
    code = {i: sum(1 << b for b in range(64) if x[b] > 0) for i, x in v.items()}
    want = []
    for q in (i for i in v if i % 100 == 0):
        d = sorted(((code[i] ^ code[q]).bit_count(), i) for i in code if i != q)[:10]
        want += [(q, n, i, x) for n, (x, i) in enumerate(d, 1)]
    assert got == sorted(want)


def rows_made(spark, run):
    """What run() made in all, by node of its plans that is an exchange to the driver or makes rows."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in iterated(store.executionsList())}
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made = Counter()
    for e in iterated(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in iterated(store.planGraph(e.executionId()).allNodes()):
                for m in iterated(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made[node.name()] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def iterated(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_hamming_broadcasts_no_values_to_look_up(spark):
    df, _ = table(spark, 5, 3000)
    assert rows_made(spark, lambda: hamming_topk.search(df).collect())["BroadcastExchange"] <= 3000


def test_hamming_makes_no_row_of_a_value_to_look_up(spark):
    df, _ = table(spark, 6, 3000)
    made = rows_made(spark, lambda: hamming_topk.search(df).collect())
    assert 0 < made["Generate"] <= 3000


def nearest_codes(rows, k=10):
    """By brute force, of (id, code) pairs without repeats."""
    out = []
    for q, c in rows:
        if q % 100 == 0:
            out += [(q, d, i) for i, x in rows if i != q for d in [(x ^ c).bit_count()]]
    best = {}
    for q, d, i in sorted(out):
        best.setdefault(q, []).append((d, i))
    return [(q, n, i, d) for q in sorted(best) for n, (d, i) in enumerate(best[q][:k], 1)]


def test_hamming_in_many_blocks_is_exact(spark):
    df, v = table(spark, 7, 1500)
    want = nearest_codes([(i, sum(1 << b for b in range(64) if x[b] > 0)) for i, x in v.items()])
    for block in (100, 700):
        assert sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in hamming_topk.search(df, block=block).collect()) == want


def test_hamming_of_an_id_with_many_codes(spark):
    near = [(0, [1.0] * 64)] + [(0, [1.0] * n + [-1.0] + [1.0] * (63 - n)) for n in range(20)]
    far = [(i, [-1.0] * (5 + i) + [1.0] * (59 - i)) for i in range(1, 30)]
    got = hamming_topk.search(spark.createDataFrame(near + far, "vec_id long, embedding array<float>"))
    assert {r.vec_id for r in got.collect()} <= set(range(1, 30)) and got.filter("rank = 1").count() == 1 and got.count() == 10


def test_index_agrees_with_comparing_all():
    r = np.random.default_rng(8)
    for n, bits in ((1, 2**64 - 1), (40, 2**64 - 1), (3000, 2**64 - 1), (3000, 0xFF0000000003F), (20000, 0xFFFFFFFFFF)):
        codes = np.unique(r.integers(0, 2**64, n, dtype=np.uint64) & np.uint64(bits))
        ids, copies = r.permutation(len(codes)), r.integers(1, 4, len(codes))
        asked = np.concatenate([codes[:20], r.integers(0, 2**64, 20, dtype=np.uint64)])
        index = hamming_topk.Index(codes.view(np.int64), ids, copies)
        for worst in (64, 9):
            q, e, d = index.search(asked.view(np.int64), np.full(len(asked), worst), 10)
            for i, c in enumerate(asked):
                x = np.bitwise_count(codes ^ c).astype(np.int64)
                by = np.lexsort((ids, x))
                enough = x[by][np.searchsorted(np.cumsum(copies[by]), 11)] if copies.sum() > 10 else 64
                by = by[:11][x[by[:11]] <= min(worst, enough)]
                assert e[q == i].tolist() == by.tolist() and d[q == i].tolist() == x[by].tolist()


def test_segments_cover_the_code():
    for n in (1, 2, 300, 10_000, 10**9, 10**14):
        cut = hamming_topk.segments(n)
        assert [a for a, _ in cut] == [sum(w for _, w in cut[:i]) for i in range(len(cut))] and sum(w for _, w in cut) == 64


def test_queries_and_pipeline(spark, sf):
    ids = [name.split("_")[0] for name in queries.QUERIES]
    assert ids == [f"op{n}" for n in range(1, 11)] and set(queries.SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 50
        assert docs.filter("n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert rows.filter("piece = 0").count() == docs.count()


def test_pipeline_stages_without_rows_or_values(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "", "", 0, "x"), (1, "", "", "", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        assert stage(spark, odd, sf).count() >= 0
    assert corpus_pipeline.without_near_duplicates(spark, odd, sf).count() == 3
