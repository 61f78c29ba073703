"""Queries over the given tables for scalars, lexicon loaders, readings, detectors and resolution, each with its SQL.

The tables hold Latin text. Where an operator asks for Han characters, letters are mapped to Han ones one by one, in the query
and in its SQL alike, and the words of a text are cut to one or two letters, so that there are single characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import phonetic
from quillspark.functions import text as T
from quillspark.operators import detect, entities, lm, lookups, resolve
from quillspark.plans.queries import query, table
from quillspark.plans.stages import stage
from quillspark.sources import lexicons

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Han characters for a to z: consecutive code points, so that rules on letters are rules on them.
HAN = "".join(chr(0x4E00 + i) for i in range(26))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- scalars

_WIDE, _NARROW = _quoted(T.FULL_WIDTH), _quoted(T.HALF_WIDTH)
_PUNC = T.character_class(T.PUNCTUATION).replace("'", "''")
_SENTENCE = "[" + T.character_class(T.SENTENCE_PUNCTUATION)[1:-1].replace("'", "''") + r"\s\x{85}\x{A0}\x{3000}\x{0B}]"


@query("space_and_width", f"""select doc_id, md5(translate(text, ' 　', '')) as bare, md5(translate(text, ' ', '')) as bare_narrow, md5(translate(text, {_NARROW}, {_WIDE})) as wide,
  md5(translate(translate(text, {_NARROW}, {_WIDE}), {_WIDE}, {_NARROW})) as back, length(text) as chars, strlen(text)::bigint as bytes from documents""")
def space_and_width(spark, sf_dir):
    t, md5 = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", md5(T.without_spaces(t, True)).alias("bare"), md5(T.without_spaces(t)).alias("bare_narrow"), md5(T.full_width(t)).alias("wide"), md5(T.half_width(T.full_width(t))).alias("back"),
        T.word_count(t).cast("bigint").alias("chars"), F.octet_length(T.utf8(t)).cast("bigint").alias("bytes"),
    )


@query("punctuation", f"""select doc_id, md5(regexp_replace(text, '{_PUNC}+$', '')) as stripped, md5(regexp_replace(text, '{_SENTENCE}', '', 'g')) as removed,
  translate(text, {_quoted(T.PUNCTUATION)}, '') = translate(lower(text), {_quoted(T.PUNCTUATION)}, '') as same,
  md5(regexp_replace(regexp_replace(translate(text, '{LETTERS}', '{HAN}'), '{T.character_class(T.STOPS)}+', ',', 'g'), '[^{T.HAN},]', '', 'g')) as stops,
  md5(trim(array_to_string(list_slice(string_split(substr(text, 1, 500), chr(10)), 1, 3), chr(10)))) as cut from documents""")
def punctuation(spark, sf_dir):
    t, md5 = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", md5(T.strip_last_punctuation(t)).alias("stripped"), md5(T.remove_punctuation(t)).alias("removed"), T.same_but_punctuation(t, F.lower(t)).alias("same"),
        md5(T.uniform_stops(F.translate(t, LETTERS, HAN))).alias("stops"), md5(T.cut_content(t, 500, 3, "\n")).alias("cut"),
    )


@query("character_classes", f"""with c as (select ch, count(*) as n from (select unnest(string_split(text || '中文！％', '')) as ch from documents) where ch <> '' group by 1)
select ch, n, regexp_full_match(ch, '[{T.HAN}]*') as han, regexp_full_match(ch, '[0-9]+') as number, regexp_full_match(ch, '[A-Za-z]+') as alphabet,
  not regexp_full_match(ch, '[{T.HAN}]*|[0-9]+|[A-Za-z]+') as other, contains({_quoted(T.PUNCTUATION)}, ch) as punctuation,
  unicode(ch) between 19968 and 40959 as cjk, ch in (' ', chr(9), chr(10), chr(13), chr(160), '　') as space from c""")
def character_classes(spark, sf_dir):
    text = F.concat("text", F.lit("中文！％"))
    c = table(spark, sf_dir, "documents").select(F.explode(F.split(text, "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).filter("ch <> ''")
    ch = F.col("ch")
    return c.select("ch", "n", T.is_han(ch).alias("han"), T.is_number(ch).alias("number"), T.is_alphabet(ch).alias("alphabet"), T.is_other(ch).alias("other"), T.is_punctuation(ch).alias("punctuation"), T.is_cjk(ch).alias("cjk"), T.is_space(ch).alias("space"))


@query("local_times", "select event_id, ts + interval 8 hour as local from events")
def local_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.local_time(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("local"))


@query("callers", """select c_custkey, case when c_custkey * 97 > 10000 then 'module' when c_custkey * 97 > 0 and c_custkey * 97 < 10000 then 'product' end as caller,
  case when c_custkey * 97 in (97, 194) then 'first' when c_custkey * 97 = 291 then 'second' else 'other' end as "group" from customer""")
def callers(spark, sf_dir):
    from quillspark.sources.documents import authorised, credential_group

    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 97).cast("string").alias("business_id"))
    return credential_group(authorised(c), {"first": ["97", "194"], "second": ["291"]}).drop("business_id")


# --- lexicon loaders: the lines of a file are made from a table


def _lines(spark: SparkSession, sf_dir: str, name: str, line: Column, n: str) -> DataFrame:
    return table(spark, sf_dir, name).select(line.alias("line"), F.col(n).cast("bigint").alias("n"))


@query("key_value_lines", "select c_mktsegment as key, arg_max(c_name, c_custkey) as value from customer group by 1")
def key_value_lines(spark, sf_dir):
    return lexicons.key_value(_lines(spark, sf_dir, "customer", F.concat_ws("\t", "c_mktsegment", "c_name"), "c_custkey"))


@query("key_values_lines", """with l as (select p_brand as key, arg_max(string_split(p_type, ' '), p_partkey) as v from part group by 1), e as (select key, unnest(v) as value, generate_subscripts(v, 1) - 1 as rank from l)
select key, value, rank::int as rank from e""")
def key_values_lines(spark, sf_dir):
    return lexicons.key_values(_lines(spark, sf_dir, "part", F.concat_ws("\t", "p_brand", "p_type"), "p_partkey"), "\t", " ")


@query("counted_values_lines", """with l as (select l_orderkey as k, l_returnflag as v, count(*) as c from lineitem group by 1, 2), r as (select k, v, c, row_number() over (partition by k order by v) - 1 as rank from l)
select k::varchar as key, v as value, c as count, rank::int as rank from r where c >= 2""")
def counted_values_lines(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("c"))
    line = F.concat_ws("\t", "l_orderkey", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "c"))), lambda x: F.concat_ws(":", x["l_returnflag"], x["c"])), ","))
    src = each.groupBy("l_orderkey").agg(line.alias("line")).select("line", F.col("l_orderkey").alias("n"))
    return lexicons.key_values_frequent(src, "\t", ",")


@query("many_keys_lines", """with l as (select n_nationkey as n, n_name || ',' || n_regionkey::varchar as keys, ['a' || n_nationkey::varchar, 'b' || n_regionkey::varchar] as v from nation),
e as (select unnest(string_split(keys, ',')) as key, v, n from l), last as (select key, arg_max(v, n) as v from e group by 1)
select key, unnest(v) as value, (generate_subscripts(v, 1) - 1)::int as rank from last""")
def many_keys_lines(spark, sf_dir):
    line = F.concat(F.col("n_name"), F.lit(","), "n_regionkey", F.lit("\ta"), "n_nationkey", F.lit(",b"), "n_regionkey")
    return lexicons.many_key_values(_lines(spark, sf_dir, "nation", line, "n_nationkey"), "\t", ",")


@query("entry_lines", "select p_name as entry, p_partkey as rank, p_brand in (select p_brand from (select p_brand from part order by p_partkey limit 7)) as early from part")
def entry_lines(spark, sf_dir):
    entries = lexicons.line_list(_lines(spark, sf_dir, "part", F.col("p_name"), "p_partkey"))
    early = lexicons.first_keys(_lines(spark, sf_dir, "part", F.concat_ws("\t", "p_brand", "p_name"), "p_partkey"), 7).select(F.col("entry").alias("p_brand"), F.lit(True).alias("e"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("rank"), "p_brand")
    return entries.join(brands, "rank").join(early, "p_brand", "left").select("entry", "rank", F.coalesce("e", F.lit(False)).alias("early"))


@query("fixed_pair_lines", """select 'head' as side, p_brand as anchor, 'py' || p_partkey::varchar as py, unnest(string_split(p_type, ' ')) as cand, (generate_subscripts(string_split(p_type, ' '), 1) - 1)::int as rank from part""")
def fixed_pair_lines(spark, sf_dir):
    line = F.concat(F.lit("head\t"), F.col("p_brand"), F.lit("\tpy"), F.col("p_partkey"), F.lit("|||"), F.replace("p_type", F.lit(" "), F.lit("|||")))
    return lexicons.fixed_pairs(_lines(spark, sf_dir, "part", line, "p_partkey"))


@query("typed_name_lines", """with e as (select p_size::varchar as kind, p_brand as py, p_partkey as n, unnest(string_split(p_type, ' ')) as name, generate_subscripts(string_split(p_type, ' '), 1) as pos from part)
select kind, py, name, (row_number() over (partition by kind, py order by n, pos) - 1)::int as rank from e""")
def typed_name_lines(spark, sf_dir):
    line = F.concat_ws("\t", "p_size", "p_brand", F.replace("p_type", F.lit(" "), F.lit("\t")))
    return lexicons.typed_names(_lines(spark, sf_dir, "part", line, "p_partkey"))


@query("cast_lines", """with e as (select n_nationkey as n, unnest([n_name, 'the ' || n_name]) as title, [lower(n_name), 'x' || n_regionkey::varchar] as py, [n_name, n_regionkey::varchar] as name from nation)
select title, unnest(py) as py, unnest(name) as name, (generate_subscripts(py, 1) - 1)::int as rank from e""")
def cast_lines(spark, sf_dir):
    line = F.concat(F.col("n_name"), F.lit("|||the "), F.col("n_name"), F.lit("\t"), F.lower("n_name"), F.lit("|||x"), F.col("n_regionkey"), F.lit("\t"), F.col("n_name"), F.lit("|||"), F.col("n_regionkey"))
    return lexicons.video_casts(_lines(spark, sf_dir, "nation", line, "n_nationkey"))


@query("polyphone_lines", """with e as (select c_nationkey::varchar as char, c_mktsegment as reading from customer group by 1, 2), many as (select * from e where char in (select char from e group by 1 having count(*) > 1))
select distinct a.reading, b.reading as other from many a join many b on a.char = b.char and a.reading <> b.reading""")
def polyphone_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("r"))
    src = lines.select(F.concat(F.col("c_nationkey"), F.lit(":"), F.array_join("r", "\t")).alias("line"), F.col("c_nationkey").cast("bigint").alias("n"))
    return lexicons.polyphones(src)[1]


@query("vocabulary_lines", """select p_name as token, max(p_partkey)::bigint as id from part group by 1""")
def vocabulary_lines(spark, sf_dir):
    return lexicons.vocabulary(table(spark, sf_dir, "part").select(F.col("p_name").alias("line"), F.col("p_partkey").cast("bigint").alias("n")))


@query("prefix_lookup", """with k as (select distinct unnest([substr(p_name, 1, 2), '_' || right(p_name, 2)]) as key, p_name as word from part) select p.p_partkey, count(*) as n, min(k.word) as first from (select p_partkey, '_' || right(p_name, 2) as key from part) p join k using (key) group by 1""")
def prefix_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = lexicons.prefix_keys(part.select(F.col("p_name").alias("word")))
    asked = part.select("p_partkey", F.concat(F.lit("_"), F.substring(F.col("p_name"), -2, 2)).alias("k"))
    return lookups.lookup(asked, keys, {"k": "key"}).groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("word").alias("first"))


# --- readings

_SPLIT = "case when length({0}) = 1 then '' else regexp_extract({0}, '^(zh|ch|sh|b|p|m|f|d|t|n|l|g|k|h|j|q|x|r|z|c|s|y|w)?(.*)$', 1) end as i{1}, case when length({0}) = 1 then {0} else regexp_extract({0}, '^(zh|ch|sh|b|p|m|f|d|t|n|l|g|k|h|j|q|x|r|z|c|s|y|w)?(.*)$', 2) end as f{1}"


def _syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct first four letters of words of part names and nations."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).union(table(spark, sf_dir, "nation").select(F.lower("n_name")))
    return words.select(F.substring("w", 1, 4).alias("s")).filter("s rlike '^[a-z]+$'").distinct()


_SYLLABLES = "syl as (select distinct substr(w, 1, 4) as s from (select unnest(string_split(lower(p_name), ' ')) as w from part union all select lower(n_name) from nation) where regexp_full_match(substr(w, 1, 4), '[a-z]+'))"


@query("syllable_pairs", f"""with {_SYLLABLES}, p as (select a.s as a, b.s as b, {_SPLIT.format("a.s", 1)}, {_SPLIT.format("b.s", 2)} from syl a join syl b on substr(a.s, 1, 1) = substr(b.s, 1, 1) and a.s < b.s)
select a, b, (case when i1 = i2 then 1 else 0 end + case when f1 = f2 then 2 else 0 end)::int as same, levenshtein(a, b) <= 1 as similar, (case when levenshtein(a, b) <= 1 then 2 else 3 end)::int as kind from p""")
def syllable_pairs(spark, sf_dir):
    s = _syllables(spark, sf_dir)
    p = s.select(F.col("s").alias("a"), F.substring("s", 1, 1).alias("k")).join(s.select(F.col("s").alias("b"), F.substring("s", 1, 1).alias("k")), "k").filter("a < b")
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", phonetic.same_initial_or_final(a, b).alias("same"), phonetic.similar_reading(a, b).alias("similar"), phonetic.pronunciation_type(a, b, F.array().cast("array<string>")).alias("kind"))


def _both_sql(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in phonetic.both_ways(pairs).items())


@query("confusable_readings", f"""with {_SYLLABLES}, p as (select s, {_SPLIT.format("s", 1)} from syl union select x.a, {_SPLIT.format("x.a", 1)} from (values {_both_sql(phonetic.CONFUSED_SYLLABLES)}, ('yong', 'you')) x(a, b)),
ini(a, b) as (values {_both_sql(phonetic.CONFUSED_INITIALS)}), fin(a, b) as (values {_both_sql(phonetic.CONFUSED_FINALS)}), whole(a, b) as (values {_both_sql(phonetic.CONFUSED_SYLLABLES)}, ('yong', 'you'))
select distinct py, other from (select s as py, b || f1 as other from p join ini on a = i1 union all select s, i1 || b from p join fin on a = f1 union all select s, b from p join whole on a = s)""")
def confusable_readings(spark, sf_dir):
    known = list(phonetic.both_ways(phonetic.CONFUSED_SYLLABLES)) + ["yong"]
    s = _syllables(spark, sf_dir).union(spark.createDataFrame([(x,) for x in known], "s string")).distinct()
    return s.select(F.col("s").alias("py"), F.explode(phonetic.confusable(F.col("s"))).alias("other"))


@query("homophones", """with r as (select distinct p_brand as char, regexp_replace(p_type, '[0-9]', '', 'g') as key from part) select distinct a.char, b.char as homophone from r a join r b on a.key = b.key and a.char <> b.char""")
def homophones(spark, sf_dir):
    return phonetic.homophones(table(spark, sf_dir, "part").select(F.col("p_brand").alias("char"), F.concat(F.col("p_type"), F.lit("3")).alias("reading")))


# --- detectors: clauses of benchmark's words, eight a clause, in Han letters

_WORDS_SQL = f"list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: translate(substr(w, 1, 1 + length(w) % 2), '{LETTERS}', '{HAN}'))"
#: The fixture's model: each word makes its text more unlikely by its first letter's place in the alphabet modulo 5.
COSTS = (0, 1, 8, 27, 512)
_COST = f"({list(COSTS)})[(unicode({{0}}) - 19968) % 5 + 1]"
_PPL = "1.0 + list_sum(list_transform({0}, lambda w: " + _COST.format("w") + "))"
_CLAUSES_SQL = f"""b as (select item_id, {_WORDS_SQL} as ws from benchmark where len({_WORDS_SQL}) > 0),
cl as (select item_id, k as sno, ws[k * 8 + 1 : k * 8 + 8] as words from (select item_id, ws, unnest(range(0, (len(ws) + 7) // 8)) as k from b)),
an as (select item_id, sno, words, len(words) as n, {_PPL.format("words")} as raw, unnest(words) as w, generate_subscripts(words, 1) - 1 as j from cl)"""
_NEXT = f"translate({{0}}, '{HAN}', '{HAN[1:] + HAN[0]}')"
_BEFORE = f"translate({{0}}, '{HAN}', '{HAN[-1] + HAN[:-1]}')"


def _likely(words: list[str]) -> float:
    return 1.0 + sum(COSTS[(ord(w[0]) - 0x4E00) % 5] for w in words)


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses as the detectors read them."""
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.translate(F.substring(w, F.lit(1), 1 + F.length(w) % 2), LETTERS, HAN))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), words.alias("ws")).filter("size(ws) > 0")
    c = b.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 8).cast("int"))).alias("sno"), "ws").withColumn("words", F.slice("ws", F.col("sno") * 8 + 1, F.lit(8)))
    c = c.select("doc_id", "sno", F.lit(5).alias("para"), F.lit(0).alias("data_type"), "words", F.transform("words", lambda w: F.lit(1)).alias("flags"))
    return stage(detect.clause_rows(c), "fixture-clauses")


def _shift(back: bool, name: str = "w") -> Column:
    return F.translate(name, HAN, HAN[-1] + HAN[:-1] if back else HAN[1:] + HAN[0])


def _lexicon(spark: SparkSession, sf_dir: str, back: bool) -> DataFrame:
    """word, cand, rank: of each word the one with letters shifted by one place, and by two."""
    words = _clauses(spark, sf_dir).select(F.explode("words").alias("word")).distinct().withColumn("one", _shift(back, "word"))
    return words.withColumn("two", _shift(back, "one")).select("word", F.posexplode(F.array("one", "two")).alias("rank", "cand")).select("word", "cand", "rank")


def _found(spark: SparkSession, sf_dir: str, lex: detect.Lexicons) -> DataFrame:
    """The errors of all clauses with one detector's lexicon."""
    clauses = _clauses(spark, sf_dir)
    ready = detect.scored(clauses, detect.candidates(clauses, lex), lm.scorer(_likely))
    out = detect.resolved(ready, lex).filter("type is not null")
    return out.select(F.col("doc_id").cast("bigint").alias("item_id"), "sno", "wrong", "right", "type", F.round("prob", 6).alias("prob"), "char_pos")


#: Candidates of words of a length by a lexicon of letters shifted back, with their ratio; the offsets of words.
_RATIOS_SQL = f"""off as (select item_id, sno, j, coalesce(sum(length(w)) over (partition by item_id, sno order by j rows between unbounded preceding and 1 preceding), 0) as place from an),
cand as (select an.*, 0 as rank, {_BEFORE.format("w")} as cand from an union all select an.*, 1, {_BEFORE.format(_BEFORE.format("w"))} from an),
ratios as (select *, (raw - {_COST.format("w")} + {_COST.format("cand")}) / raw as ratio from cand)"""


def _first_sql(where: str, least: int, below: str, kind: int) -> str:
    return f"""with {_CLAUSES_SQL}, {_RATIOS_SQL}, taken as (select *, row_number() over (partition by item_id, sno order by j, rank) as rn from ratios where {where} and n >= {least} and ratio < {below})
select t.item_id, t.sno::int as sno, w as wrong, cand as "right", {kind}::int as type, round(1 - ratio, 6) as prob, place::int as char_pos from taken t join off using (item_id, sno, j) where rn = 1"""


_TITLE = "case when sno = 0 then {0} else {1} end"


@query("single_character_errors", _first_sql("length(w) = 1", 4, _TITLE.format(0.1, 0.5), 2))
def single_character_errors(spark, sf_dir):
    lex = _lexicon(spark, sf_dir, True).filter(F.length("word") == 1)
    return _found(spark, sf_dir, detect.Lexicons(same_sound=stage(lex, "fixture-lexicon")))


@query("word_errors", _first_sql("length(w) = 2", 5, _TITLE.format(0.36, 0.4), 3))
def word_errors(spark, sf_dir):
    lex = _lexicon(spark, sf_dir, True).filter(F.length("word") == 2)
    return _found(spark, sf_dir, detect.Lexicons(same_sound=stage(lex, "fixture-lexicon")))


@query("near_word_errors", _first_sql("length(w) = 2", 5, _TITLE.format(0.33, 0.5), 4))
def near_word_errors(spark, sf_dir):
    lex = _lexicon(spark, sf_dir, True).filter(F.length("word") == 2)
    return _found(spark, sf_dir, detect.Lexicons(near_words=stage(lex, "fixture-lexicon")))


@query("split_errors", f"""with {_CLAUSES_SQL}, off as (select item_id, sno, j, coalesce(sum(length(w)) over (partition by item_id, sno order by j rows between unbounded preceding and 1 preceding), 0) as place from an),
ratios as (select *, '{HAN[0]}' || '{HAN[0]}' as cand, (raw - {_COST.format("w")}) / raw as ratio from an where length(w) = 2)
select r.item_id, r.sno::int as sno, w as wrong, cand as "right", 19::int as type, round(1 - ratio, 6) as prob, place::int as char_pos from ratios r join off using (item_id, sno, j) where ratio < 0.1 and w <> cand""")
def split_errors(spark, sf_dir):
    words = _clauses(spark, sf_dir).select(F.explode("words").alias("key")).distinct().filter(F.length("key") == 2)
    return _found(spark, sf_dir, detect.Lexicons(split=stage(words.select("key", F.lit(f"{HAN[0]}/{HAN[0]}").alias("value"), F.lit(0).alias("rank")), "fixture-lexicon")))


def _near_sql(side: str) -> str:
    return "lag(length(w) = 1) over (partition by item_id, sno order by j)" if side == "left" else "lead(length(w) = 1) over (partition by item_id, sno order by j)"


@query("nonword_candidates", f"""with {_CLAUSES_SQL}, run as (select *, lead(w) over (partition by item_id, sno order by j) as nxt, lag(w) over (partition by item_id, sno order by j) as prv, length(w) = 1 and (coalesce({_near_sql("left")}, false) or coalesce({_near_sql("right")}, false)) as run from an),
tops as (select distinct w || nxt as pair from run where nxt is not null and length(w || nxt) = 2), c as (select *, 0 as rank, {_NEXT.format("w")} as cand from run where run union all select *, 1, {_NEXT.format(_NEXT.format("w"))} from run where run)
select item_id, sno::int as sno, j::int as b, cand || nxt as cand, 1::int as pref, rank::int as rank from c where nxt is not null and cand || nxt in (select pair from tops)
union all select item_id, sno, j - 1, prv || cand, 2, rank from c where prv is not null and prv || cand in (select pair from tops)""")
def nonword_candidates(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    pairs = c.select(F.explode(lookups.windows(F.col("words"), 2, 2)).alias("w")).select(F.array_join("w.words", "").alias("word")).filter(F.length("word") == 2).distinct()
    lex = _lexicon(spark, sf_dir, False).filter(F.length("word") == 1)
    found = detect.candidates(c, detect.Lexicons(same_sound=stage(lex, "fixture-lexicon"), top_words=stage(pairs, "fixture-tops"))).filter("det = 'nonword'")
    return found.select(F.col("doc_id").cast("bigint").alias("item_id"), "sno", "b", "cand", "pref", "rank")


@query("settled_characters", f"""with {_CLAUSES_SQL}, run as (select *, lead(w) over (partition by item_id, sno order by j) as nxt, lag(w) over (partition by item_id, sno order by j) as prv, length(w) = 1 and (coalesce({_near_sql("left")}, false) or coalesce({_near_sql("right")}, false)) as run from an),
tops as (select distinct w || nxt as pair from run where nxt is not null and length(w || nxt) = 2 and item_id % 2 = 0)
select item_id, sno::int as sno, j::int as j, count(*) as sides from (select * from run where run and w || nxt in (select pair from tops) union all select * from run where run and prv || w in (select pair from tops)) group by 1, 2, 3""")
def settled_characters(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    pairs = c.filter(F.col("doc_id").cast("bigint") % 2 == 0).select(F.explode(lookups.windows(F.col("words"), 2, 2)).alias("w")).select(F.array_join("w.words", "").alias("word")).filter(F.length("word") == 2).distinct()
    found = detect.candidates(c, detect.Lexicons(top_words=stage(pairs, "fixture-tops"))).filter("det = 'settled'")
    return found.groupBy(F.col("doc_id").cast("bigint").alias("item_id"), "sno", F.col("at").alias("j")).agg(F.count("*").alias("sides"))


# --- resolution


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two characters from order lines, whose types cycle through the known ones."""
    kinds = F.array(*[F.lit(k) for k in (0, 1, 51, 2, 3, 4, 10, 7, 9, 57)])
    li = table(spark, sf_dir, "lineitem")
    pair = lambda a, b: F.translate(F.concat(a, b), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", HAN)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("sno"), pair(F.col("l_returnflag"), F.col("l_linestatus")).alias("wrong"), pair(F.col("l_returnflag"), F.when(F.col("l_suppkey") % 2 == 0, "S").otherwise(F.col("l_linestatus"))).alias("right"),
        (F.col("l_partkey") % 20).cast("int").alias("char_pos"), F.element_at(kinds, (F.col("l_partkey") % 10 + 1).cast("int")).alias("type"), (F.col("l_discount") * 10).alias("prob"), (F.col("l_suppkey") % 4).cast("int").alias("repeats"),
        (F.col("l_suppkey") % 3).cast("int").alias("para"), F.lit("c").alias("clause"), F.lit("s").alias("sentence"), F.lit(0).alias("seq"),
    )


_FRAGMENTS_SQL = f"""e as (select l_orderkey as doc_id, l_linenumber - 1 as sno, translate(l_returnflag || l_linestatus, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{HAN}') as wrong, translate(l_returnflag || case when l_suppkey % 2 = 0 then 'S' else l_linestatus end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{HAN}') as r,
  l_partkey % 20 as char_pos, ([0, 1, 51, 2, 3, 4, 10, 7, 9, 57])[l_partkey % 10 + 1] as type, l_discount * 10 as prob, l_suppkey % 4 as repeats, l_suppkey % 3 as para from lineitem)"""


@query("error_characters", f"""with {_FRAGMENTS_SQL} select type::int as type, (char_pos + 1)::int as char_pos, right(wrong, 1) as wrong, right(r, 1) as "right", (case when type in (7, 57, 9) and repeats >= 2 then 1 else 0 end)::int as recall,
  (type in (0, 7, 57, 9, 10) or (sno = 0 and ((type = 1 and prob > 0.5) or (type = 51 and prob > 0.8) or (type in (2, 3, 4) and prob > 0.8)))) as kept, count(*) as n from e where right(wrong, 1) <> right(r, 1) group by 1, 2, 3, 4, 5, 6""")
def error_characters(spark, sf_dir):
    rows = resolve.characters(_fragments(spark, sf_dir).withColumn("term_imp", F.lit(1)))
    kept = resolve.kept_anyway(F.col("type"), F.col("prob"), F.col("wrong"), F.col("right"), F.col("sno"))
    return rows.groupBy("type", "char_pos", "wrong", "right", "recall", kept.alias("kept")).agg(F.count("*").alias("n"))


@query("error_importance", f"""with {_FRAGMENTS_SQL} select type::int as type, para::int as para, wrong, r as "right", (case when type in (7, 9, 0, 17, 10, 57) or para <= 1 or wrong <> r then 2 when r in ('{HAN[0]}{HAN[0]}', '{HAN[17]}{HAN[5]}') then 0 else 1 end)::int as term_imp, count(*) as n from e group by 1, 2, 3, 4, 5""")
def error_importance(spark, sf_dir):
    e, none = _fragments(spark, sf_dir), F.create_map().cast("map<string,string>")
    listed = F.col("right").isin(HAN[0] * 2, HAN[17] + HAN[5])
    imp = resolve.importance(F.col("type"), F.col("wrong"), F.col("right"), F.col("para"), phonetic.same_reading(F.col("wrong"), F.col("right"), none), listed)
    return e.groupBy("type", "para", "wrong", "right", imp.alias("term_imp")).agg(F.count("*").alias("n"))


@query("video_marks", f"""with {_FRAGMENTS_SQL} select type::int as type, round(prob, 2) as prob, (case when (type = 0 and prob > 0.001) or (type = 1 and prob > 0.75) or (type = 2 and prob > 0.85) or (type in (10, 12) and prob > 0.5) then 2
  when type in (0, 51) or (type = 1 and prob > 0.7) or (type = 2 and prob > 0.68) or (type in (3, 4) and prob > 0.7) then 3 else 1 end)::int as mark, count(*) as n from e group by 1, 2, 3""")
def video_marks(spark, sf_dir):
    mark = resolve.video_recall(F.col("type"), F.col("prob"), F.lit(1))
    return _fragments(spark, sf_dir).groupBy("type", F.round("prob", 2).alias("prob"), mark.alias("mark")).agg(F.count("*").alias("n"))


@query("sentence_reading", """with t as (select conv_id, turn, list_transform(string_split(text, ''), lambda c: (unicode(c) % 100) / 100.0) as p from conversations where length(text) > 0)
select conv_id, turn, list_max(p)::double as prob, list_max(p) > 0.5 as wrong, len(list_filter(p, lambda x: x > 0.5))::int as hits from t""")
def sentence_reading(spark, sf_dir):
    chars = F.split("text", "")
    c = table(spark, sf_dir, "conversations").filter(F.length("text") > 0).select("conv_id", "turn", chars.alias("chars"), F.transform(chars, lambda x: (F.ascii(x) % 100) / F.lit(100.0)).alias("probs"))
    return resolve.sentence_judgement(c).select("conv_id", "turn", "prob", "wrong", F.size("hits").alias("hits"))


@query("entity_spellings", """with e as (select o_custkey as doc_id, o_orderpriority as word, o_orderkey as pos from orders), c as (select doc_id, word, count(*) as n, min(pos) as first, right(word, 1) as reading from e group by 1, 2),
w as (select doc_id, reading, word as winner, row_number() over (partition by doc_id, reading order by n desc, first desc) as rn, count(*) over (partition by doc_id, reading) as k from c)
select c.doc_id, c.word, case when c.word = '3-MEDIUM' then '7_baidu' else '7_freq' end as rule, case when c.word = '3-MEDIUM' then '3-MEDIAN' else w.winner end as "right" from c left join w on c.doc_id = w.doc_id and c.reading = w.reading and rn = 1 and k > 1 where c.word = '3-MEDIUM' or c.word <> w.winner""")
def entity_spellings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(entities.PERSON).alias("cls"), F.col("o_orderpriority").alias("word"), F.col("o_orderkey").alias("pos"))
    counted = entities.counts(rows).withColumn("reading", F.substring(F.col("word"), -1, 1))
    empty = spark.createDataFrame
    wrong = empty([("3-MEDIUM", "3-MEDIAN")], "key string, value string")
    return entities.name_errors(counted, "reading", wrong, empty([], "title string, py string, name string, rank int"), empty([], "name string")).select("doc_id", "word", "rule", "right")
