"""Text functions, splitters and lexicons."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import phonetic, variants, wordpiece
from quillspark.functions import text as T
from quillspark.operators import split
from quillspark.sources import documents, lexicons


def one(spark, value, f, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,raw,want",
    [
        (T.clean, "a\tb\r\nc d　e", "a b  c d e"),
        (T.without_spaces, "a b　c", "ab　c"),
        (lambda c: T.without_spaces(c, True), "a b　c", "abc"),
        (T.half_width, "ＡＢ１！　～中", "AB1! ~中"),
        (T.full_width, "AB 1", "ＡＢ　１"),
        (T.uniform, "ＡＢｃ", "abc"),
        (T.uniform_stops, "你好!!?世界abc。", "你好,世界,"),
        (T.plain_punctuation, " “你好”，！！【x】\t\t ", '"你好",!(x)。'),
        (T.strip_last_punctuation, "好的。！…", "好的"),
        (T.remove_punctuation, "a, b。c!（d）", "abcd"),
        (T.remove_punctuation, "\u3000北　京\u00a0《x》\u2003", "北京《x》"),
        (lambda c: T.cut_content(c, 20, 2), "ab      cd      efghij", "ab      cd"),
        (T.printable, "a\x00b​c\td", "abc d"),
    ],
)
def test_normalisers(spark, f, raw, want):
    assert one(spark, raw, f) == want


@pytest.mark.parametrize(
    "f,raw,want",
    [
        (T.is_han, "中文", True), (T.is_han, "", True), (T.is_han, "中a", False), (T.is_number, "12", True), (T.is_number, "", False), (T.is_alphabet, "aZ", True),
        (T.is_other, "!", True), (T.is_other, "a", False), (T.valid_sentence, "你好ab", True), (T.valid_sentence, "你abcdefg", False), (T.valid_sentence, "  ", False), (T.valid_sentence, "", False),
        (T.is_punctuation, "……", True), (T.is_punctuation, "", True), (T.is_punctuation, "好", False), (T.is_space, " ", True), (T.is_control, "​", True), (T.is_control, "\t", False),
        (T.is_any_punctuation, "$", True), (T.is_any_punctuation, "。", True), (T.is_any_punctuation, "a", False), (T.is_cjk, "㐀", True), (T.is_cjk, "a", False), (T.is_cjk, "𠀀", True),
    ],
)
def test_predicates(spark, f, raw, want):
    assert one(spark, raw, f) is want


def test_null_texts(spark):
    for f in (T.clean, T.uniform, T.uniform_stops, T.plain_punctuation, T.strip_last_punctuation):
        assert one(spark, None, f) is None
    assert one(spark, None, T.valid_sentence) is False


def test_exemptions():
    from quillspark.operators.detect import Cascade

    clause = {"flags": [], "cands": None, "all_names": ["张三"], "norm": [], "sno": 1, "words": []}
    rows = [(1, "美里", "美丽", True), (1, "没里", "没丽", True), (1, "里人", "里仁", False), (2, "再", "他", True), (3, "王哥", "王歌", True), (3, "小明", "晓明", True), (4, "张三", "章三", True), (4, "天气", "填气", False), (8, "里里", "丽里", False)]
    for kind, wrong, right, want in rows:
        assert Cascade(clause, {"里"}, {"不"}, set(), set(), {}).exempt(kind, wrong, right) is want, (kind, wrong)


def looped(para, ends):
    rx = re.compile(f"({ends})")
    out = []
    for part in rx.split(re.sub("[\t\r\n]", " ", para)):
        if part and rx.match(part) and out:
            out[-1] += part
        elif part:
            out.append(part)
    return out


def test_sentences_are_what_a_loop_finds(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("ab好。！?;\"” \n…") for _ in range(r.randrange(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split.sentences_of(F.col("t")).alias("s")).collect()
    for x in got:
        assert x.s == looped(texts[x.i], T.SENTENCE_END), texts[x.i]


def test_caps_are_what_a_loop_keeps(spark):
    r = random.Random(1)
    docs = []
    for n in range(60):
        paras = ["".join(r.choice(["好的。", "天气很好！", "abc。", "。"]) for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(0, 12))]
        docs.append((str(n), r.choice(["标题", "", "a b"]), (" " * 6).join(paras), 0))
    want = set()
    for d, title, body, _ in docs:
        if title:
            want.add((d, 0, 0, title.replace(" ", "")))
        sno, chars = 1, 0
        for i, p in enumerate(body.split(" " * 6) if body else [], 1):
            chars += len(p)
            if chars > 2000:
                break
            for s in looped(p, T.SENTENCE_END):
                s = s.replace(" ", "")
                if s.strip() and sum(not "一" <= c <= "龥" for c in s) / len(s) <= 0.7:
                    want.add((d, sno, i, s))
                    sno += 1
            if sno > 70:
                break
    got = split.sentence_rows(spark.createDataFrame(docs, "doc_id string, title string, body string, data_type int")).collect()
    assert {(x.doc_id, x.sno, x.para, x.sentence) for x in got} == want


def test_words_offsets_runs_and_characters(spark):
    s = spark.createDataFrame([(0, "北京票亮ab12 很。")], "id int, sentence string")
    words = split.word_rows(s, split.segmenter({"北京"})(F.col("sentence")))
    assert [(x.word, x.char_off) for x in words.orderBy("idx").collect()] == [("北京", 0), ("票", 2), ("亮", 3), ("ab12", 4), (" ", 8), ("很", 9), ("。", 10)]
    chars = split.character_rows(words).collect()
    assert "".join(c.char for c in sorted(chars, key=lambda c: c.char_pos)) == "北京票亮ab12 很。"
    runs = split.runs(words, ["id"], "idx", (F.length("word") == 1) & T.is_han(F.col("word"))).collect()
    assert sorted((r.word, r.run, r.run_length) for r in runs) == [("亮", 1, 2), ("票", 1, 2)]


def test_delimited(spark):
    assert one(spark, "他说“你好”和《书》(a(b)", split.delimited) == ["《书》", "“你好”", "(b)"]


def test_latin_words(spark):
    assert one(spark, "It's a well-known fact, isn't it?", split.latin_words) == ["It's", "a", "well-known", "fact", ",", "isn't", "it", "?"]


def test_readings(spark):
    assert one(spark, "shuang", phonetic.initial) == "sh" and one(spark, "shuang", phonetic.final) == "uang" and one(spark, "a", phonetic.initial) == ""
    assert sorted(one(spark, "chen", phonetic.confusable)) == ["cen", "cheng"] and one(spark, "yong", phonetic.confusable) == ["yon", "you"]
    got = spark.createDataFrame([(["zhang", "xu"],)], "t array<string>").select(phonetic.confusable_words(F.col("t")).alias("x")).first()["x"]
    assert sorted(got) == [["zhan", "xu"], ["zhang", "xi"], ["zang", "xu"]] or sorted(map(tuple, got)) == [("zang", "xu"), ("zhan", "xu"), ("zhang", "xi")]
    table = F.create_map(*[F.lit(x) for kv in {"北": "bei3", "被": "bei4", "京": "jing1"}.items() for x in kv])
    row = spark.createDataFrame([("北京", "被京")], "a string, b string").select(
        phonetic.reading(F.col("a"), table).alias("r"), phonetic.same_reading(F.col("a"), F.col("b"), table).alias("same"), phonetic.different_tone(phonetic.reading(F.col("a"), table), phonetic.reading(F.col("b"), table)).alias("tone"),
        phonetic.pronunciation_type(F.lit("bei3"), F.lit("bei4"), F.array()).alias("p1"), phonetic.pronunciation_type(F.lit("bei3"), F.lit("mei3"), F.array()).alias("p2"), phonetic.pronunciation_type(F.lit("bei3"), F.lit("zhong1"), F.array()).alias("p3"),
        phonetic.words_similar(F.array(F.lit("bei"), F.lit("jing")), F.array(F.lit("bai"), F.lit("jin"))).alias("sim"),
    ).first()
    assert row.r == ["bei3", "jing1"] and row.same and row.tone and (row.p1, row.p2, row.p3) == (1, 2, 3) and row.sim
    h = phonetic.homophones(spark.createDataFrame([("北", "bei3"), ("被", "bei4"), ("京", "jing1")], "char string, reading string")).collect()
    assert sorted((x.char, x.homophone) for x in h) == [("北", "被"), ("被", "北")]


def test_variants_take_the_fewest_pieces(spark):
    table = {"ab": "1", "abc": "2", "cd": "3", "bcd": "4", "e": "5"}

    def ways(t):
        if not t:
            yield []
        for n in range(1, len(t) + 1):
            if n == 1 or t[:n] in table:
                for rest in ways(t[n:]):
                    yield [t[:n], *rest]

    for t in map("".join, itertools.product("abcde", repeat=5)):
        best = min(len(w) for w in ways(t))
        got = variants.converted(t, table, 3)
        assert got in {"".join(table.get(p, p) for p in w) for w in ways(t) if len(w) == best}
    entries = spark.createDataFrame(list(table.items()), "source string, target string")
    assert one(spark, "xabcde", variants.converter(entries)) == "x24"[0] + variants.converted("abcde", table, 3)
    assert one(spark, None, variants.converter(entries)) is None
    assert one(spark, "發國", lambda c: variants.single_characters(c, {"發": "发", "國": "国"})) == "发国"


def test_word_pieces(spark):
    vocabulary = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "中", "文", "!", "e"])}
    tok = wordpiece.tokenizer(vocabulary)
    assert one(spark, "UNaffable 中文! É xyz", tok) == ["un", "##aff", "##able", "中", "文", "!", "e", "[UNK]"]
    assert one(spark, None, tok) == [] and one(spark, "a" * 300, tok) == ["[UNK]"]
    f = one(spark, "中文x", wordpiece.char_features(vocabulary, 6))
    assert (f.ids, f.mask) == ([1, 6, 7, 0, 2, 0], [1, 1, 1, 1, 1, 0])


def test_lexicons(spark):
    n = lambda *lines: lexicons.numbered(spark, list(lines))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(lexicons.key_value(n("a\t1", "b\t2", "a\t3", "bad"))) == [("a", "3"), ("b", "2")]
    assert rows(lexicons.key_values(n("a:x\ty", "b:z"), ":", "\t")) == [("a", "x", 0), ("a", "y", 1), ("b", "z", 0)]
    assert rows(lexicons.key_values(n("a\tx\ty"), "\t", "\t")) == [("a", "x", 0), ("a", "y", 1)]
    assert rows(lexicons.key_values_frequent(n("a\tx:3 y:1"), "\t", " ")) == [("a", "x", 3, 0)]
    assert rows(lexicons.closure(n("a,b", "b,c"))) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert rows(lexicons.first_keys(n("a\t1", "a\t2", "b", "c"), 3)) == [("a",), ("b",)]
    assert rows(lexicons.line_list(n("x", "", "y"))) == [("x", 0), ("y", 2)]
    assert rows(lexicons.fixed_pairs(n("head\t火影\tren zhe|||忍者|||仁者"))) == [("head", "火影", "ren zhe", "仁者", 1), ("head", "火影", "ren zhe", "忍者", 0)]
    assert rows(lexicons.typed_names(n("vdo\tp\tA\tB", "vdo\tp\tC"))) == [("vdo", "p", "A", 0), ("vdo", "p", "B", 1), ("vdo", "p", "C", 2)]
    assert rows(lexicons.video_casts(n("t1|||t2\tpa|||pb\tA|||B"))) == [(t, p, x, i) for t in ("t1", "t2") for i, (p, x) in enumerate((("pa", "A"), ("pb", "B")))]
    many, other = lexicons.polyphones(n("行:hang\txing", "一:yi"))
    assert rows(many) == [("行", "hang", 0), ("行", "xing", 1)] and rows(other) == [("hang", "xing"), ("xing", "hang")]
    assert rows(lexicons.vocabulary(n("[PAD]", "a", "b"))) == [("[PAD]", 0), ("a", 1), ("b", 2)]
    assert rows(lexicons.prefix_keys(spark.createDataFrame([("一心一意",)], "word string"))) == [("_一意", "一心一意"), ("一心", "一心一意")]
    assert lexicons.as_map(lexicons.key_value(n("a\t1")), "key", "value") == {"a": "1"}
    with pytest.raises(ValueError):
        lexicons.as_map(lexicons.key_value(n("a\t1", "b\t2")), "key", "value", rows=1)


def test_document_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\t标题\t正文\nbroken\n")
    (tmp_path / "b.tsv").write_text("\t".join(["2", *"bcdefg", "T", "B"]) + "\n")
    (tmp_path / "c.tsv").write_text("3\tx\t视频\n")
    (tmp_path / "d.json").write_text('{"business_id":"b","doc_id":"4","title":"t","body_content":"c"}\n')
    got = [f(spark, str(tmp_path / x)).first() for f, x in ((documents.from_tsv, "a.tsv"), (documents.from_batch_tsv, "b.tsv"), (documents.from_video_tsv, "c.tsv"), (documents.from_json, "d.json"))]
    assert [(r.doc_id, r.title, r.body, r.channel_id, r.data_type) for r in got] == [("1", "标题", "正文", 0, 0), ("2", "T", "B", 12, 0), ("3", "视频", "", 0, 1), ("4", "t", "c", 0, 0)]
    docs = documents.from_tsv(spark, str(tmp_path / "a.tsv"))
    documents.write_once(docs, str(tmp_path / "p"), False)
    documents.write_once(docs.limit(0), str(tmp_path / "p"), False)
    assert documents.from_parquet(spark, str(tmp_path / "p")).count() == 1 and documents.one_document(docs, "1").count() == 1
    documents.write_tsv(docs.withColumn("title", F.lit("a\tb")), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0].startswith("1\t\ta b\t")
    users = spark.createDataFrame([("12345",), ("77",), ("0",), ("x",), (None,)], "business_id string")
    assert [r.caller for r in documents.authorised(users).collect()] == ["module", "product", None, None, None]
    assert [r.group for r in documents.credential_group(users, {"g": ["77"]}).collect()] == ["other", "g", "other", "other", "other"]
    assert documents.as_json(docs).first()["json"].startswith('{"doc_id":"1"')
