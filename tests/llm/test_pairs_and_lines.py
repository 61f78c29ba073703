"""n-gram Jaccard join, line dedup, mixing."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, line_dedup, mixing, ngram_join

DOCS = "doc_id long, text string, source string, n long, kept string"


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=1, groups=25):
    r = random.Random(seed)
    rows, n = [], 0
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 5, 6, 8, 12, 30, 60, 200, 700]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, max(1, len(t) // 60)])):
                t = t or ["again"]
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], [r.choice(words)], [t[i], r.choice(words)]])
            if g % 5 == 0:
                t += passage
            rows.append((n, r.choice([" ", "\n", " \t"]).join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Same Words"), (n + 4, "same words"), (n + 5, "x " * 20000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_is_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df).collect())
    assert got == sorted(brute_components(rows))


def test_similar_group_without_a_centre(spark):
    """Many near copies of a text that isn't there: members link with some of the others only."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(60):
        t = list(base)
        for _ in range(2):
            t[r.randrange(len(t))] = f"x{n}_{r.random()}"
        rows.append((n, " ".join(t)))
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.similar(df).collect()) == sorted(brute_components(rows))


@pytest.mark.parametrize("differ", [0, 2])
def test_similar_buckets_of_several_blocks(spark, monkeypatch, differ):
    """A group that fills many blocks of a bucket, and unlike texts that share a long passage, which are in its buckets too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for n in range(70):
        t = list(base)
        for _ in range(differ):
            t[r.randrange(len(t))] = f"x{r.random()}"
        rows.append((n, " ".join([*t, f"end{n}"])))
    rows += [(100 + n, " ".join(base[: 110 + n % 3] + [f"o{n}_{i}" for i in range(40)])) for n in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    got = ngram_join.similar(df).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_components(rows))
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted(brute_links(rows))


def test_similar_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "q r s t u v")]
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (7, 2, 7)], key=str)
    assert ngram_join.similar(df.limit(0)).count() == 0


def near_pairs(r, size, universe):
    """Two sets of about this size that link."""
    for _ in range(50):
        a = np.unique(universe(size))
        drop = r.integers(0, max(1, int(0.1 * size)) + 1)
        b = np.unique(np.r_[a[drop:], universe(r.integers(0, max(1, int(0.1 * size)) + 1))])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            yield a, b


@pytest.mark.parametrize("crowded", [False, True])
def test_signatures_lose_no_pair(crowded):
    """Any two sets that link agree in a signature that one of them looks up, also if all their shingles fall into one segment."""
    r = np.random.default_rng(3)
    bands = ngram_join.Bands(1 << 20)
    top = np.uint64(2**40 if crowded else 2**63)
    for size in [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 20, 30, 33, 36, 40, 100, 130, 400, 1500]:
        for a, b in near_pairs(r, size, lambda n: r.integers(0, top, n).astype(np.uint64)):
            flat, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
            key, ids, flags = ngram_join.signatures(flat, sizes, np.array([1, 2], np.uint64), bands)
            assert len(ngram_join.matched(key, ids, flags)[0]), (len(a), len(b))


def test_few_sets_are_cut_twice():
    r = np.random.default_rng(4)
    bands = ngram_join.Bands(1 << 20)
    sizes = sorted({*range(5, 60), *bands.lo[:45].tolist(), *(bands.lo[:45] - 1).tolist(), 100, 1000, 10_000} - {0, 1, 2, 3, 4})
    for size in sizes:  # band edges too
        sets = [np.unique(r.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(max(3, 20_000 // size))]
        for below in (False, True):
            a = ngram_join.allotted(np.concatenate(sets), np.array([len(x) for x in sets]), bands, below)
            assert (below or a["crowded"].mean() < 0.2) and a["weak"].mean() < 0.01, size


def test_words_hash_alike_wherever_they_stand():
    text = "Ab é\x1cx ab " + "z" * 3_000_000 + "\tAB\x0bé\x1cx"
    h = ngram_join.word_hashes(text)
    assert len(h) == 6 and h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


def test_large_buckets_keep_their_members():
    key = np.full(30, 9, np.uint32)
    ids = np.arange(30, dtype=np.uint64)
    left, right, of, member = ngram_join.matched(key, ids, np.full(30, ngram_join.INDEX | ngram_join.PROBE, np.uint8))
    assert not len(left) and list(member) == list(ids) and set(of) == {9}
    for flag in (ngram_join.PROBE, ngram_join.CUT_INDEX, ngram_join.CUT_PROBE):
        assert not len(ngram_join.matched(key, ids, np.full(30, flag, np.uint8))[2])  # nothing of that kind looks up its like


def test_sketches_never_overstate():
    r = np.random.default_rng(5)
    import pandas as pd

    for n, m in [(10, 12), (500, 900), (3000, 2600), (9000, 12000)]:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], r.integers(0, 2**63, m).astype(np.uint64)])
        x, y = pd.Series([ngram_join.sketch(a)]), pd.Series([ngram_join.sketch(b)])
        length = min(len(x[0]), len(y[0]))
        differ = int(np.bitwise_count(ngram_join._bits(x, length) ^ ngram_join._bits(y, length)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    owners = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                owners[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(owners.get(key(x), ())) > 1 and min(owners[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_is_brute_force(spark, batches, fanout):
    r = random.Random(batches)
    pool = [f"shared line number {i}" for i in range(30)] + ["short", "", "  ", "É accented line here", "é accented line here", "A" * 5000, "tab\tinside the line"]
    rows = []
    for n in range(80):
        lines = [r.choice([r.choice(pool), f"own line of {n} {r.random()}"]) for _ in range(r.randrange(0, 12))]
        rows.append((n, "\n".join(r.choice([x, "  " + x.upper() + "\t", x]) for x in lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "shared line number 1\nx"), (None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "s", 1, "clash") for d, t in rows], DOCS)
    out = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
    got = sorted(((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept.encode()).hexdigest()) for x in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert set(out.columns) == {"doc_id", "text", "source", "n", "kept", "n_lines", "n_dropped"}


def test_line_dedup_repeated_rows_and_no_rows(spark):
    rows = [(1, "one shared line here"), (1, "one shared line here"), (2, "One shared line here \nmine")]
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    assert sorted((x.doc_id, x.kept) for x in line_dedup.dedup_lines(df).collect()) == [(1, "one shared line here")] * 2 + [(2, "mine")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_merged_by_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        said = runs.add(spark.createDataFrame([(i, i, 10 * b, False) for i in range(b, b + 3)], "h1 long, h2 long, owner long, many boolean"))
        assert sorted((r.h1, r.owner) for r in said.collect()) == ([] if not b else [(b, 10 * max(0, b - 2)), (b + 1, 10 * max(0, b - 1))])
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sum(r.count() for r in runs.runs()) == 7
    runs.close()
    assert runs.runs() == []


def test_runs_are_opened_again(spark, tmp_path):
    """A later session goes on from the folder, and what it reads is neither shuffled nor sorted."""
    shape = "h1 long, h2 long, owner long, many boolean"
    first = line_dedup.LineRuns(spark, fanout=3, buckets=3, folder=str(tmp_path))
    first.add(spark.createDataFrame([(i, -i, i, False) for i in range(100)], shape))
    first.add(spark.createDataFrame([(i, -i, 1000 + i, False) for i in range(50, 200)], shape))
    for name in list(first.paths):
        spark.sql(f"drop table {name}")  # another session's catalog doesn't have them
    again = line_dedup.LineRuns(spark, fanout=3, folder=str(tmp_path))
    assert again.levels == first.levels and again.buckets == 3
    said = again.add(spark.createDataFrame([(i, -i, 5000 + i, False) for i in (7, 150, 300)], shape))
    assert sorted((r.h1, r.owner) for r in said.collect()) == [(7, 7), (150, 1150)]
    assert [len(level) for level in again.levels] == [0, 1] and again.runs()[0].count() == 201
    with line_dedup.setting(spark, line_dedup._ORDERED, "true"), line_dedup.setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = again.runs()[0].hint("merge").join(again.runs()[0].select(*line_dedup.KEY), line_dedup.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_texts_that_lose_many_lines(spark):
    rows = [(1, "\n".join(f"shared line number {i}" for i in range(3000))), (2, "\n".join(x for i in range(3000) for x in (f"Shared line number {i}", f"own line {i}", "short")))]
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(df).collect()}
    assert [(d, *got[d]) for d in (1, 2)] == brute_lines(rows)


def test_mixing_follows_its_distribution(spark):
    rows = [(i, f"t{i}", "big" if i < 3000 else "small", 1, "k") for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, weights={"big": 0.25, "small": 0.75})
    got = out.groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in got}
    assert abs(share["big"] - 1000) < 120 and abs(share["small"] - 3000) < 200
    per = collections.Counter(r.copies for r in out.filter("source = 'small' and copy = 1").collect())
    for k, p in ((1, 3 * np.exp(-3)), (2, 4.5 * np.exp(-3)), (3, 4.5 * np.exp(-3))):
        assert abs(per[k] - 1000 * p) < 60
    again = mixing.mix(df.repartition(7), weights={"big": 0.25, "small": 0.75})
    assert sorted(r.shuffle_key for r in out.collect()) == sorted(r.shuffle_key for r in again.collect())


def test_mixing_edges(spark):
    rows = [(1, None, None, 1, "k"), (None, "", "a", 1, "k"), (2, "x", "a", 1, "k"), (2, "x", "a", 1, "k")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n", "copies")
    out = mixing.mix(df, epochs=40.0).collect()
    assert {(r.doc_id, r.source) for r in out} == {(1, None), (None, "a"), (2, "a")}
    assert len(out) == sum(r.copies for r in out if r.copy == 1)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, weights={}).count() == 0
    high = mixing.rates(df, epochs=900.0).filter("source = 'a'").first()
    assert abs(high["below"][-1] - 1) < 1e-9 and len(high["below"]) < 130
    assert high["parts"] == -(-high["rate"] // mixing.PART_RATE)


def brute_copies(doc, rate, seed="mix-1"):
    """Copies of a document: for each part of its rate the inverse of the Poisson distribution, summed up term by term."""
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    total = 0
    for p in range(parts):
        name = seed + (f"/{p}" if p else "") + f":{doc}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        term = below = math.exp(-rate / parts)
        k = 0
        while below < u:
            k += 1
            term *= rate / parts / k
            below += term
        total += k
    return total


def test_mixing_is_brute_force_at_all_rates(spark):
    """Large rates are exactly Poisson too: mean and variance are the rate."""
    rows = [(i, "t", "big" if i < 1500 else ("rare" if i < 1600 else "one"), 1, "k") for i in range(1601)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"big": 0.5, "rare": 0.4, "one": 0.1}
    rate = {s: 100 * 1601 * w / n for (s, w), n in zip(weights.items(), (1500, 100, 1), strict=True)}
    got = {r.doc_id: r.copies for r in mixing.mix(df, weights, epochs=100.0).filter("copy = 1").collect()}
    assert got == {i: brute_copies(i, rate[s]) for i, _, s, _, _ in rows}
    rare = np.array([got[i] for i in range(1500, 1600)])
    assert abs(rare.mean() - rate["rare"]) < 4 * math.sqrt(rate["rare"] / 100) and 0.6 < rare.var() / rate["rare"] < 1.6


def test_mixing_deals_out_rows_without_ids(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a", i, "k") for i in range(400)], DOCS)
    out = mixing.mix(df, epochs=5.0)
    sizes = collections.Counter(r.p for r in out.select(F.spark_partition_id().alias("p")).collect())
    assert len(sizes) > 1 and max(sizes.values()) < 0.6 * sum(sizes.values())


def test_forests_connect_what_all_hopeful_pairs_connect():
    import pandas as pd

    r = np.random.default_rng(8)
    for _ in range(20):
        sets = []
        for _ in range(6):
            base = r.integers(0, 2**63, 60).astype(np.uint64)
            for _ in range(r.integers(1, 9)):
                s = base.copy()
                s[r.integers(0, 60, r.integers(0, 9))] = r.integers(0, 2**63)
                sets.append(np.unique(s))
        ids = np.sort(r.choice(10**6, len(sets), False))
        root = np.where(r.random(len(sets)) < 0.3, ids[0], ids)
        size, bits = np.array([len(s) for s in sets]), ngram_join._bits(pd.Series([ngram_join.sketch(s) for s in sets]), ngram_join.SKETCH // 8)

        def joined(pairs):
            name = dict(zip(ids.tolist(), root.tolist(), strict=True))
            for a, b in zip(*pairs, strict=True):
                x, y = name[int(a)], name[int(b)]
                name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
            return name

        few, many = (f(root, size, ids, bits, 80, 100) for f in (ngram_join._spanning, ngram_join._every))
        assert joined(few) == joined(many) and len(few[0]) < len(ids)


def brute_links(rows):
    """Of each row the number of other sets that its set links with."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    unique = {x for x in sets if x}
    links = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in unique) for x in unique}
    return [(d, links.get(x, 0)) for (d, _), x in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("block", [512, 3])
def test_links_are_all_counted(spark, monkeypatch, block):
    """Every link between different texts, inside groups of near copies too, however the groups are dealt."""
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    r, rows = random.Random(3), corpus(3, 12)
    base = [f"b{i}" for i in range(120)]
    for n in range(30):
        t = list(base)
        t[r.randrange(len(t))] = f"x{n}"
        t[r.randrange(len(t))] = f"y{n}"
        rows += [(1000 + 2 * n, " ".join(t)), (1001 + 2 * n, " ".join(t).upper())]
    df = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in rows], DOCS)
    assert sorted((x.doc_id, x.n_links) for x in ngram_join.similar(df).collect()) == sorted(brute_links(rows))


def test_link_counts_in_parts(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.choice(40, 36).astype(np.uint64)) for _ in range(30)]
    inside = np.zeros(30, np.int64)
    across = np.arange(30) % 2
    link = np.array([[i != j and 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y)) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    for postings in (1 << 20, 50):
        monkeypatch.setattr(ngram_join, "POSTINGS", postings)
        assert (ngram_join.linked_with(sets, inside, 60, 100) == link.sum(axis=1)).all()
        assert (ngram_join.linked_with(sets, across, 60, 100) == (link & (across[:, None] != across)).sum(axis=1)).all()
