"""Detection, resolution, entities, metrics, joins, the whole check, and the registered queries."""

import random
import statistics
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from quillspark.operators import detect, entities, lm, lookups, resolve
from quillspark.plans import check as plan
from quillspark.plans import queries
from quillspark.sources.documents import shaped, with_responses
from quillspark.streaming import metrics

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows):
    return sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    rows = got.select(*sorted(got.columns)).collect()
    assert rows
    if name in queries.SQL:
        want = duck.sql(f"select * from ({queries.SQL[name]})")
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert rounded(rows) == rounded([tuple(r[i] for i in order) for r in want.fetchall()])


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_documented_examples(spark):
    docs = shaped(spark.createDataFrame([("d1", "北京是手都", "", 0), ("d2", "北京是首都", "", 0), ("d3", "北京时中国的首都", "北京时中国的首都。" * 5, 1), ("d5", None, None, 0)], "doc_id string, title string, body string, data_type int"))
    details, summary = plan.check(docs, queries.fixture_models(spark))
    by = {}
    for r in details.collect():
        by.setdefault(r.doc_id, set()).add((r.sno, r.idx, r.wrong, r.correct, r.typo))
    assert by["d1"] == {(0, 3, "手", "首", 1)} and "d2" not in by
    assert "d3" not in by  # a wrong text that a document repeats is dropped
    s = {r.doc_id: r for r in summary.collect()}
    assert set(s) == {"d1", "d2", "d3", "d5"} and s["d1"].title_num == 1 and s["d1"].typo_level >= 1 and s["d2"].all_num == 0
    answers = {r.doc_id: r for r in with_responses(details, summary).collect()}
    assert len(answers["d1"].details) == 1 and answers["d2"].details == []


def test_circuit_breaker(spark):
    models = queries.fixture_models(spark)
    models.skip_detection = True
    docs = shaped(spark.createDataFrame([("d1", "北京是手都")], "doc_id string, title string"))
    details, summary = plan.check(docs, models)
    assert details.count() == 0 and summary.first()["ret_code"] == 0


def clause(**kw):
    words = kw.pop("words")
    base = {"doc_id": "d", "sno": 1, "clause": 0, "words": words, "norm": words, "flags": [1] * len(words), "punc": [1] * len(words), "offs": list(range(len(words))), "cands": [], "judged_wrong": False}
    return base | kw


def cand(det, b, text, ratio, e=None, at=None, rank=0, pref=0, rule=""):
    return {"det": det, "b": b, "e": b if e is None else e, "cand": text, "at": b if at is None else at, "rank": rank, "pref": pref, "rule": rule, "ratio": ratio}


def run(c, chars=(), words=(), sure=(), similar=(), tones=None, neural=None):
    got = detect.Cascade(c, set(chars), set(words), set(sure), set(similar), tones or {}).run(neural)
    return [(t["b"], t["e"], t["right"], t["type"], round(t["prob"], 3)) for t in got]


WORDS = list("甲乙丙丁戊己")


def test_first_accepted_candidate_wins_and_closes_the_gate():
    cands = [cand("char", 1, "x", 0.6), cand("char", 1, "y", 0.4, rank=1), cand("char", 1, "z", 0.1, rank=2), cand("word", 3, "q", 0.01)]
    assert run(clause(words=WORDS, cands=cands)) == [(1, 1, "y", 2, 0.6)]


def test_titles_are_stricter():
    assert run(clause(words=WORDS, sno=0, cands=[cand("char", 1, "y", 0.4)])) == []


def test_suspects_need_the_labeller():
    cands = [cand("char", 1, "y", 0.7), cand("char_near", 2, "z", 0.6, pref=1)]
    assert run(clause(words=WORDS, cands=cands)) == []
    assert run(clause(words=WORDS, cands=cands, judged_wrong=True)) == [(2, 2, "z", 6, 0.4)]


def test_nonwords_settle_words_and_exempt_ones_are_silent():
    hit = [cand("nonword", 1, "xy", 0.5, e=2, pref=1)]
    assert run(clause(words=WORDS, cands=hit)) == [(1, 2, "xy", 1, 0.5)]
    assert run(clause(words=WORDS, cands=[*hit, cand("settled", 1, "", 1.0)])) == []
    assert run(clause(words=WORDS, cands=[*hit, cand("settled", 1, "", 1.0)], ), sure={"乙"}) == [(1, 2, "xy", 1, 0.5)]
    exempt = [cand("nonword", 1, "x丙", 0.5, e=2, pref=1), cand("char", 1, "y", 0.1)]
    assert run(clause(words=WORDS, cands=exempt), chars={"乙"}) == []
    assert run(clause(words=WORDS[:2], cands=hit)) == []


def test_idioms_fixed_pairs_names_and_splits():
    words = ["甲", "乙丙", "丁", "戊", "己庚"]
    assert run(clause(words=words, cands=[cand("idiom", 0, "甲乙丙X", 3.0, e=2)])) == [(0, 2, "甲乙丙X", 0, -2.0)]
    two = [cand("idiom", 0, "甲乙YX", 1.5, e=2)]
    assert run(clause(words=words, cands=two), tones={"丙": "a", "Y": "a", "丁": "c", "X": "c"}) == [(0, 2, "甲乙YX", 0, -0.5)] and run(clause(words=words, cands=two)) == []
    pair = [cand("fixed", 3, "A", 0.8, at=2), cand("fixed", 1, "BB", 0.5, at=2, pref=1)]
    assert run(clause(words=words, cands=pair)) == [(1, 1, "BB", 10, 0.5)]
    name = [cand("name", 1, "AB", None, rule="7_baidu"), cand("char", 3, "y", 0.01)]
    assert run(clause(words=words, cands=[x | {"ratio": 1.0} if x["ratio"] is None else x for x in name])) == [(1, 1, "AB", 57, 1.0)]
    assert run(clause(words=words, cands=[cand("split", 4, "A B", 0.05)])) == [(4, 4, "AB", 19, 0.95)]
    assert run(clause(words=words, cands=[cand("split", 4, "A B", 0.12)], judged_wrong=True)) == [(4, 4, "AB", 19, 0.88)]


def test_similar_words_and_neural_titles():
    assert run(clause(words=["甲甲", *"乙丙丁戊"], cands=[cand("word", 0, "AB", 0.1)]), similar={("甲甲", "AB")}) == []
    title = clause(words=WORDS, sno=0)
    assert run(title, neural=lambda c: [cand("neural", 2, "x", 0.9) | {"sure": True}]) == [(2, 2, "x", 17, 0.9)]
    doubt = lambda c: [cand("neural", 2, "x", 0.5) | {"sure": False}]
    assert run(title, neural=doubt) == [] and run(clause(words=WORDS, sno=0, judged_wrong=True), neural=doubt) == [(2, 2, "x", 22, 0.5)]


def test_a_failing_clause_does_not_end_the_job(spark):
    rows = spark.createDataFrame([("d", 1, 0, ["甲"], ["甲"], [1], [1], [0], [("char", 0, 0, 0, 5, 5, "x", "", 0.1)])], "doc_id string, sno int, clause int, words array<string>, norm array<string>, flags array<int>, punc array<int>, offs array<int>, cands array<struct<det:string,at:int,pref:int,rank:int,b:int,e:int,cand:string,rule:string,ratio:double>>")
    got = detect.resolved(rows, detect.Lexicons(), neural=lambda c: 1 / 0).collect()
    assert got == [] or got[0]["error"]


def test_entities_of_several_words(spark):
    """The run of protected words from one on is an entity; persons are single words; words to be checked are none."""
    c = spark.createDataFrame([("d", 0, 0, ["去", "北", "京路", "了", "王君", "，"], [1, -1, -1, 1, -2, -2], [1, 1, 1, 1, 1, 0])], "doc_id string, sno int, clause int, words array<string>, flags array<int>, punc array<int>")
    assert [(r.word, r.last, r.span) for r in detect.entity_spans(c).orderBy("j").collect()] == [("北", 2, "北京路"), ("京路", 2, "京路"), ("王君", 4, "王君")]
    names = spark.createDataFrame([("d", "北京路", "9_vdo", "北京鹿"), ("d", "王君", "7_freq", "王军"), ("d", "了", "9_vdo", "啦"), ("d", "京路", "7_freq", "京"), ("x", "北", "9_vdo", "背")], "doc_id string, word string, rule string, right string")
    got = detect.candidates(c, detect.Lexicons(), names).collect()
    assert sorted((r.b, r.e, r.cand, r.rule) for r in got) == [(1, 2, "北京鹿", "9_vdo"), (4, 4, "王军", "7_freq")]


def test_the_labeller_is_heard_where_it_is_asked(spark):
    """A verdict on a body sentence counts if a suspect asked for it, or if it is an early sentence without errors."""
    models = queries.fixture_models(spark)
    hit = lambda sents: sents.select("doc_id", "sno", F.lit(0).alias("char_pos"), F.substring("sentence", 1, 1).alias("char"), F.substring("sentence", 1, 1).alias("word"), F.lit(0.9).alias("prob"), F.lit(False).alias("protected"), "sentence", F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("correction"))
    models.label = hit
    docs = shaped(spark.createDataFrame([("d1", "", "北京很大。中国很大。首都很大。北京很大。" , 0)], "doc_id string, title string, body string, data_type int"))
    got = plan.check(docs, models)[0].collect()
    assert sorted((r.sno, r.typo, r.correct) for r in got) == [(1, 20, "X"), (2, 20, "X")]


def test_failed_sentences_leave_a_mark(spark):
    models = queries.fixture_models(spark)
    models.neural = lambda c: 1 / 0
    docs = shaped(spark.createDataFrame([("d1", "北京很大", "")], "doc_id string, title string, body string"))
    details, summary = plan.check(docs, models)
    assert details.count() == 0 and summary.first()["ret_code"] == -1
    models.mask_errors = True
    assert plan.check(docs, models)[1].first()["ret_code"] == 0


def test_protected_words_and_passed_windows(spark):
    s = spark.createDataFrame([("d", 0, 0, 0, ["他", "说", "“", "你", "好", "”", "了"], [1, 1, -2, 1, 1, -2, 1])], "doc_id string, sno int, para int, data_type int, words array<string>, flags array<int>")
    c = detect.clause_rows(s)
    assert c.first()["flags"] == [1, 1, -4, -4, -4, -4, 1] and c.first()["punc"] == [1, 1, 0, 1, 1, 0, 1] and c.first()["to_norm"] == [0, 1, 2, 2, 3, 4, 4]
    assert detect.passed_windows(c, F.array(F.lit("他说"))).first()["flags"][:2] == [0, 0]
    scored = detect.scored(c, detect.candidates(c, detect.Lexicons()), lm.scorer(lambda w: float(len(w))))
    assert "raw_ppl" in detect.explained(scored).first()["explained"]


def test_majority_and_entity_errors(spark):
    rows = [("d", 0, w, i) for i, w in enumerate(["王军", "王军", "王君", "张蔓玉", "土田晃知", "北平"])] + [("d", 3, "节目", 9), ("d", 1, "伦墩", 10), ("d", 3, "狮子网了", 11), ("e", 0, "王君", 0), ("d", 4, "书", 12)]
    c = entities.counts(spark.createDataFrame(rows, "doc_id string, cls int, word string, pos int"))
    py = {"王军": "wangjun", "王君": "wangjun", "张蔓玉": "zhangmanyu", "土田晃知": "tutianhuangzhi", "狮子网了": "shi zi wang le"}
    table = F.create_map(*[F.lit(x) for kv in py.items() for x in kv])
    c = c.withColumn("reading", F.coalesce(F.try_element_at(table, F.col("word")), F.col("word")))
    kv = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    casts = spark.createDataFrame([("节目", "tutianhuangzhi", "土田晃之", 0)], "title string, py string, name string, rank int")
    listed = spark.createDataFrame([("王君",)], "name string")
    got = entities.name_errors(c, "reading", kv("张蔓玉", "张曼玉"), casts, listed.limit(0))
    assert sorted((r.doc_id, r.word, r.rule, r.right) for r in got.collect()) == [("d", "土田晃知", "7_vdo", "土田晃之"), ("d", "张蔓玉", "7_baidu", "张曼玉"), ("d", "王君", "7_freq", "王军")]
    assert ("d", "王军", "王君") in {(r.doc_id, r.word, r.right) for r in entities.name_errors(c, "reading", kv("a", "b"), casts, listed).collect()}
    other = entities.other_errors(c, "reading", spark.createDataFrame([("shi zi wang le", "狮子王了", 0)], "py string, name string, rank int"), kv("伦墩", "伦敦"))
    assert sorted((r.word, r.rule, r.right) for r in other.collect()) == [("伦墩", "9_loc_baidu", "伦敦"), ("狮子网了", "9_vdo", "狮子王了")]
    assert entities.all_errors(got, other).count() == 5
    doc = {r.doc_id: r for r in entities.document_entities(c).collect()}
    assert doc["d"].count_0["王军"] == 2 and "书" not in doc["d"].all_names


def test_pronouns_are_what_a_loop_finds(spark):
    r = random.Random(3)
    rows, want = [], set()
    for d in range(40):
        before = -1
        for s in range(12):
            n = r.choice([0, 0, 1, 1, 2])
            known = r.randrange(0, n + 1)
            g = r.choice([1, 2])
            men, women, he, she = (r.choice([0, 0, 1]) for _ in range(4))
            rows.append((d, s, n, known, g if known else None, men, women, he, she))
            if known > 1 or n > 1 or (known == 0 and before == -1) or (men and women):
                before = -1
                continue
            now = before if known == 0 else g
            before = -1 if known == 0 else g
            if he == 0 or she == 0:
                continue
            if (now == 1 and women) or (now == 2 and men):
                before = -1
                continue
            if now in (1, 2):
                want.add((d, s))
    df = spark.createDataFrame(rows, "doc_id int, sno int, names int, gendered int, gender int, men int, women int, he int, she int")
    assert {(x.doc_id, x.sno) for x in entities.carried(df).filter("fires").collect()} == want


def test_pronoun_errors(spark):
    words = [("d", 1, i, w, -2 if w == "王军" else 1, 1, i, "s") for i, w in enumerate(["王军", "说", "他", "和", "她"])]
    w = spark.createDataFrame(words, "doc_id string, sno int, idx int, word string, flag int, para int, char_off int, sentence string")
    got = entities.pronoun_errors(w, spark.createDataFrame([("王军", "1")], "key string, value string")).collect()
    assert [(x.wrong, x.right, x.type, x.term_imp) for x in got] == [("她", "他", 23, 2)]


ERR = "doc_id string, sno int, char_pos int, clause string, wrong string, right string, type int, prob double, sentence string, term_imp int, recall int, seq int"


def test_merge_with_the_labeller(spark):
    rows = [("d", 1, 0, "c", "a", "b", 1, 0.4, "s", 1, 0), ("d", 1, 3, "c", "甲", "乙", 2, 0.6, "s", 1, 0), ("d", 1, 5, "c", "i", "j", 0, 0.1, "s", 1, 0), ("d", 2, 0, "c", "x", "y", 2, 0.5, "s", 1, 0), ("d", 3, 1, "c", "p", "q", 2, 0.5, "s", 1, 0), ("d", 3, 0, "c", "later", "q", 2, 0.5, "s", 1, 0)]
    rows = [(*r, n) for n, r in enumerate(rows)]  # the first error found stays where none would, not the first in place
    hits = [("d", 1, 3, "甲", "甲", 0.9, False, "s", "c", "乙"), ("d", 1, 7, "丙", "丙", 0.8, False, "s", "c", None), ("d", 1, 8, "丁", "丁", 0.8, True, "s", "c", "z"), ("d", 1, 9, "王", "王哥", 0.8, False, "s", "c", "z"), ("d", 3, 4, "呢", "呢", 0.8, False, "s", "c", "z")]
    labels = spark.createDataFrame(hits, "doc_id string, sno int, char_pos int, char string, word string, prob double, protected boolean, sentence string, clause string, correction string")
    got = resolve.with_labels(spark.createDataFrame(rows, ERR), labels, ["呢"]).collect()
    assert {r.wrong: r.term_imp for r in got}["丙"] == 2
    assert sorted((r.sno, r.char_pos, r.wrong, r.right, r.type) for r in got) == [(1, 3, "甲", "乙", 2), (1, 5, "i", "j", 0), (1, 7, "丙", "X", 20), (2, 0, "x", "y", 2), (3, 1, "p", "q", 2)]
    ask = resolve.to_label(spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("d", 9), ("0", 0)], "doc_id string, sno int"), spark.createDataFrame(rows, ERR).filter("sno = 1"), labels.filter("sno = 99"))
    assert sorted((r.doc_id, r.sno) for r in ask.collect()) == [("d", 0), ("d", 2)]


def test_characters_levels_and_video(spark):
    e = spark.createDataFrame([("d", 1, "c", "手都", "首都", 4, 1, 0.9, "s", 1, 0, 0), ("d", 1, "c", "的人", "地仁", 9, 10, 0.9, "s", 1, 0, 1), ("d", 1, "c", "王君", "王军", 20, 7, 1.0, "s", 1, 3, 2)], "doc_id string, sno int, clause string, wrong string, right string, char_pos int, type int, prob double, sentence string, term_imp int, repeats int, seq int")
    assert sorted((r.char_pos, r.wrong, r.right, r.recall) for r in resolve.characters(e).collect()) == [(4, "手", "首", 0), (10, "人", "仁", 0), (21, "君", "军", 1)]
    v = spark.createDataFrame([(0, 0.5, 2), (1, 0.72, 3), (1, 0.8, 2), (2, 0.7, 3), (3, 0.6, 0), (51, 0.1, 3), (10, 0.6, 2)], "type int, prob double, want int")
    assert all(r.got == r.want for r in v.withColumn("got", resolve.video_recall(F.col("type"), F.col("prob"), F.lit(0))).collect())
    t = spark.createDataFrame([(["a", "b"], [0.2, 0.9]), ([], [])], "chars array<string>, probs array<double>")
    got = resolve.sentence_judgement(t).collect()
    assert got[0].wrong and got[0].hits[0].char == "b" and not got[1].wrong
    c = spark.createDataFrame([("d", 1, 0, "a", 0.9, 0, "s"), ("d", 1, 0, "b", 0.6, 1, "s"), ("d", 1, 1, "c", 0.9, 0, "s"), ("d", 1, 2, None, None, None, None)], "doc_id string, sno int, char_pos int, cand string, ratio double, rank int, single string")
    assert {r.char_pos: r.correction for r in resolve.corrections(c).collect()} == {0: "b", 1: "c", 2: "X"}


def points(n=400):
    r = random.Random(5)
    t0 = datetime(2024, 1, 1)
    return [(t0 + timedelta(milliseconds=37 * i), r.choice(["a", "b"]), "i", {"k": r.choice(["x", "y"])}, r.choice(["m", "n"]), r.choice(metrics.METHODS), r.choice([str(r.randrange(100)), "1.5", "oops"])) for i in range(n)]


def test_rollup_is_what_a_loop_finds(spark):
    rows = points()
    want = {}
    for ts, app, inst, tags, m, method, v in rows:
        if v != "oops":
            want.setdefault((ts.replace(microsecond=0), app, f'{{"k":"{tags["k"]}"}}', m, method), []).append((ts, float(v)))
    one = {"ADD": sum, "AVG": statistics.mean, "MAX": max, "MIN": min, "MIDDLE": statistics.median, "NONE": lambda x: x[-1]}
    got = {(r.window_start, r.app_mark, r.tags, r.metric, r.method): r.value for r in metrics.rolled_up(spark.createDataFrame(rows, metrics.METRIC)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(one[k[4]]([v for _, v in sorted(x)]), 9) for k, x in want.items()}


def test_stream_is_the_batch(spark, tmp_path):
    rows = points(300)
    df = spark.createDataFrame(rows, metrics.METRIC)
    df.write.json(str(tmp_path / "in"))
    last = max(r[0] for r in rows).replace(microsecond=0)
    failed = []

    def write(batch, n):
        if not failed:
            failed.append(n)
            raise OSError("once")
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    q = metrics.sink(metrics.rolled_up(metrics.source(spark, str(tmp_path / "in")), watermark="0 seconds"), write, str(tmp_path / "state"), available_now=True)
    q.awaitTermination()
    key = lambda d: sorted((r.window_start, r.app_mark, r.tags, r.metric, r.method, round(r.value, 9)) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(metrics.rolled_up(df).filter(F.col("window_start") < F.lit(last)))
    assert metrics.packaged(df, ["app_mark", "metric"], 100).select("package").distinct().count() <= 3


def test_example_series(spark):
    rows = [(datetime(2024, 1, 1), f"app{a}", "i", {}, "req_cnt", "ADD", str(i)) for a in (1, 2) for i in range(1, 11)]
    assert [r.value for r in metrics.rolled_up(spark.createDataFrame(rows, metrics.METRIC)).collect()] == [55.0, 55.0]


def test_joins(spark):
    spans = spark.createDataFrame([("d", 0, 5, "a"), ("d", 100, 300, "b"), ("e", 0, 1, "c"), ("d", 7, 7, "z")], "k string, begin int, end int, v string")
    pts = spark.createDataFrame([("d", p) for p in (0, 4, 5, 99, 100, 299, 300)] + [("e", 0), ("f", 0)], "k string, pos int")
    assert sorted((r.k, r.pos, r.v) for r in lookups.within_spans(pts, spans, ["k"]).collect()) == [("d", 0, "a"), ("d", 4, "a"), ("d", 100, "b"), ("d", 299, "b"), ("e", 0, "c")]
    arcs = spark.createDataFrame([("c", 0, 0, "B", 0), ("c", 1, 2, "X Y", 0)], "id string, begin int, end int, text string, rank int")
    clauses = spark.createDataFrame([("c", ["a", "b", "c"])], "id string, words array<string>")
    best = lookups.lattice_paths(clauses, arcs, ["id"], lambda w: float(sum(map(ord, w))), k=2).collect()
    assert [(r["rank"], r["words"]) for r in sorted(best, key=lambda r: r["rank"])] == [(1, ["B", "X", "Y"]), (2, ["B", "b", "c"])]
    cells = spark.createDataFrame([("c", 0, 1, "late", 2), ("c", 0, 1, "early", 1)], "id string, begin int, end int, text string, n int")
    assert [r.text for r in lookups.gap_free_cells(cells, ["id"], ["n"]).collect()] == ["early"]
    n = lookups.neighbours(spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "k string, idx int, word string"), ["k"]).orderBy("idx").collect()
    assert [(x.prev_word, x.next_word) for x in n] == [(None, "b"), ("a", None)]


def test_language_model(spark):
    s = spark.createDataFrame([(1, "a b a".split()), (2, "a b c".split())], "id int, words array<string>")
    model = lm.PairModel.of(lm.grams(s))
    assert model.known("a") and not model.known("z") and model.ppl(["a", "b"]) < model.ppl(["b", "a"])
    assert len(model.scores(["a"])) == 2
    with pytest.raises(ValueError):
        lm.PairModel.of(lm.grams(s), most=1)
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.1]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    p = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "q")], "a string, b string")
    assert {r.b: r.similar for r in lm.similar_words(p, v).collect()} == {"y": True, "z": False, "q": False}
