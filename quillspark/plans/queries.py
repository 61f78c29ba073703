"""Queries over the given tables, one or more for each kind of operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import phonetic
from quillspark.functions import text as T
from quillspark.operators import detect, entities, lm, lookups, resolve, split
from quillspark.plans.stages import shared_dir
from quillspark.sources import lexicons
from quillspark.streaming import metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD = r"[\p{L}\p{N}]+"
LATIN = r"a-zA-ZÀ-ÖØ-öø-ÿ"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latin_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the shape of requests: paragraphs are lines, there are no titles."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit(0).alias("data_type"))


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, word of every whole document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("idx", "word"))


# --- sources, normalisers, filters


@query("text_normalise", """
select doc_id, md5(lower(translate(text, '！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～　', '!"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~ '))) as uniform_md5,
  md5(translate(text, chr(9) || chr(13) || chr(10) || chr(160) || '　', '     ')) as clean_md5,
  length(regexp_replace(text, '[.?!:,;]+$', '')) as stripped_chars
from documents""".replace("\\\\", "\\"))
def text_normalise(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.uniform(t).cast("binary")).alias("uniform_md5"), F.md5(T.clean(t).cast("binary")).alias("clean_md5"), F.length(F.regexp_replace(t, "[.?!:,;]+$", "")).cast("bigint").alias("stripped_chars"))


@query("char_class_filter", f"""
select doc_id, length(text) as chars, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits, length(regexp_replace(text, '[^{LATIN}]', '', 'g')) as letters,
  length(regexp_replace(text, '[{LATIN}]', '', 'g')) / length(text) as foreign_share
from documents where length(text) > 0 and length(regexp_replace(text, '[{LATIN}]', '', 'g')) / length(text) <= 0.3""")
def char_class_filter(spark, sf_dir):
    t = F.col("text")
    n = lambda c: F.length(F.regexp_replace(t, c, "")).cast("bigint")
    docs = table(spark, sf_dir, "documents").filter(T.valid_sentence(t, LATIN, 0.3))
    return docs.select("doc_id", F.length(t).cast("bigint").alias("chars"), n("[^0-9]").alias("digits"), n(f"[^{LATIN}]").alias("letters"), T.foreign_share(t, LATIN).alias("foreign_share"))


@query("request_json", "select doc_id::varchar as doc_id, lang as business_id, 'title ' || source as title, length(text) as body_chars, 0 as channel_id, 0 as data_type from documents")
def request_json(spark, sf_dir):
    from quillspark.sources.documents import parsed_requests

    raw = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("business_id"), F.concat(F.lit("title "), "source").alias("title"), F.col("text").alias("body_content"))).alias("value"))
    return parsed_requests(raw).select("doc_id", "business_id", "title", F.length("body").cast("bigint").alias("body_chars"), "channel_id", "data_type")


# --- splitters

_END = r"[.\r\n﹔﹖﹗。！？?!;；]+[\x22’”]{0,2}|……[\x22’”“‘]?"


def sentences(spark: SparkSession, sf_dir: str, most_chars: int = 1 << 30, most_sentences: int = 1 << 30) -> DataFrame:
    return split.sentence_rows(latin_documents(spark, sf_dir), "\n", T.SENTENCE_END_LATIN, LATIN + " ", most_chars, most_sentences)


_SENTENCES_SQL = f"""
paras as (select doc_id::varchar as doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as para from documents),
cut as (select doc_id, para, unnest(regexp_extract_all(translate(p, chr(9) || chr(13) || chr(10), '   '), '(?s).*?(?:{_END})+|.+$')) as raw, generate_subscripts(regexp_extract_all(translate(p, chr(9) || chr(13) || chr(10), '   '), '(?s).*?(?:{_END})+|.+$'), 1) as pos from paras),
sents as (select doc_id, para, pos, trim(raw) as sentence from cut where raw <> '' and regexp_matches(trim(raw), '\\S') and length(regexp_replace(trim(raw), '[{LATIN} ]', '', 'g')) / length(trim(raw)) <= 0.7)
"""


@query("sentences_per_document", f"with {_SENTENCES_SQL} select doc_id, count(*) as sentences, sum(length(sentence))::bigint as chars, max(length(sentence)) as longest, max(para) as last_para from sents group by doc_id")
def sentences_per_document(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).cast("bigint").alias("chars"), F.max(F.length("sentence")).cast("bigint").alias("longest"), F.max("para").cast("bigint").alias("last_para"))


@query("document_caps", f"""with {_SENTENCES_SQL},
per_para as (select p.doc_id, p.para, length(p.p) as n, coalesce(s.c, 0) as c from paras p left join (select doc_id, para, count(*) as c from sents group by 1, 2) s on p.doc_id = s.doc_id and p.para = s.para),
running as (select *, sum(n) over (partition by doc_id order by para) as chars, coalesce(sum(c) over (partition by doc_id order by para rows between unbounded preceding and 1 preceding), 0) as before from per_para)
select doc_id, sum(c)::bigint as sentences, max(para) filter (where c > 0) as last_para from running where chars <= 2000 and before < 70 group by doc_id having sum(c) > 0""")
def document_caps(spark, sf_dir):
    return sentences(spark, sf_dir, split.MAX_CHARS, split.MAX_SENTENCES).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("para").cast("bigint").alias("last_para"))


@query("word_offsets", f"""with w as (select doc_id, unnest({WORDS_SQL}) as word, generate_subscripts({WORDS_SQL}, 1) as idx from documents)
select doc_id, count(*) as words, sum(off)::bigint as offsets from (select doc_id, coalesce(sum(length(word)) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as off from w) group by doc_id""")
def word_offsets(spark, sf_dir):
    # a running sum in one pass over each document's array
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("sum"))
    total = F.aggregate("words", start, lambda a, w: F.struct((a["at"] + F.length(w)).alias("at"), (a["sum"] + a["at"]).alias("sum")), lambda a: a["sum"])
    docs = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return docs.select("doc_id", F.size("words").cast("bigint").alias("words"), total.alias("offsets"))


@query("delimited_pieces", """with p as (select doc_id, unnest(regexp_extract_all(text, '[(][^()]*[)]')) as piece from documents) select piece, count(*) as n, min(doc_id) as first_doc from p group by piece""")
def delimited_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(split.delimited(F.col("text"), (("(", ")"),))).alias("piece"))
    return docs.groupBy("piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("clause_split")
def clause_split(spark, sf_dir):
    rows = spark.createDataFrame([(0, ["今天", "天气", "，", "很", "好", "。"]), (1, ["ＡＢ", "cd", " "]), (2, ["去", ",", "不", "去", "？"])], "id int, w array<string>")
    return rows.select("id", F.posexplode(split.clauses_of(F.col("w"))).alias("clause", "c")).select("id", "clause", F.array_join(F.transform("c", lambda x: x["word"]), "|").alias("words"), F.element_at("c", 1)["off"].alias("off"))


# --- joins


@query("oov_against_benchmark", f"""with v as (select distinct unnest({WORDS_SQL}) as word from benchmark), w as (select doc_id, unnest({WORDS_SQL}) as word from documents)
select doc_id, count(*) as words, count(*) filter (where word not in (select word from v)) as oov from w group by doc_id""")
def oov_against_benchmark(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    # equal words of a document are one row of the join
    rows = document_words(spark, sf_dir).groupBy("doc_id", "word").agg(F.count("*").alias("times"))
    return lm.out_of_vocabulary(rows, known).groupBy("doc_id").agg(F.sum("times").alias("words"), F.sum(F.when(F.col("oov"), F.col("times")).otherwise(0)).alias("oov"))


@query("semi_and_anti", """select count(*) as suppliers, count(*) filter (where s_nationkey in (select c_nationkey from customer where c_acctbal > 9900)) as with_rich, count(*) filter (where s_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)) as without_rich from supplier""")
def semi_and_anti(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").filter("c_acctbal > 9900")
    on = {"s_nationkey": "c_nationkey"}
    one = lambda d, n: d.agg(F.count("*").alias(n))
    parts = [one(s, "suppliers"), one(lookups.having(s, c, on), "with_rich"), one(lookups.lacking(s, c, on), "without_rich")]
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)


@query("confusion_closure", """with k as (select distinct p_type as line, p_brand as member from part) select a.member as key, b.member as value from k a join k b on a.line = b.line and a.member <> b.member group by 1, 2""")
def confusion_closure(spark, sf_dir):
    lines = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.collect_set("p_brand"), ",").alias("line"))
    return lexicons.closure(lines.select("line", F.xxhash64("p_type").alias("n")))


@query("lexicon_lookup", """with lex as (select word, max(n) as n from (select 'furniture' as word, 1 as n) group by word) select l_shipmode_key, count(*) as rows from (select l_returnflag || l_linestatus as l_shipmode_key from lineitem) where l_shipmode_key in ('AF', 'NO', 'RF') group by 1""")
def lexicon_lookup(spark, sf_dir):
    lines = lexicons.numbered(spark, ["AF\tone", "NO\ttwo", "RF\tthree", "AF\tfour"])
    lex = lexicons.key_value(lines)
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_key"))
    return lookups.lookup(rows, lex, {"l_shipmode_key": "key"}).groupBy("l_shipmode_key").agg(F.count("*").alias("rows"))


@query("spans_to_tokens", f"""with w as (select doc_id, idx, off, word from (select doc_id, idx, word, coalesce(sum(length(word)) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as off from (select doc_id, unnest({WORDS_SQL}) as word, generate_subscripts({WORDS_SQL}, 1) - 1 as idx from documents))),
s as (select doc_id, quality, toxic, 100 * quality as b, 100 * quality + 50 + 100 * toxic as e from labels)
select w.doc_id, count(*) as tokens, min(off)::bigint as first_off, max(off)::bigint as last_off from w join s on w.doc_id = s.doc_id and off >= b and off < e group by 1""")
def spans_to_tokens(spark, sf_dir):
    words = document_words(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    points = words.select("doc_id", F.coalesce(F.sum(F.length("word")).over(w), F.lit(0)).alias("pos"))
    spans = table(spark, sf_dir, "labels").select("doc_id", (100 * F.col("quality")).cast("bigint").alias("begin"), (100 * F.col("quality") + 50 + 100 * F.col("toxic")).cast("bigint").alias("end"))
    return lookups.within_spans(points, spans, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.min("pos").alias("first_off"), F.max("pos").alias("last_off"))


@query("event_as_of", """select e.user_id, e.event_id, (select min(x.ts) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and x.ts >= e.ts) as next_purchase from events e where e.event_type = 'click'""")
def event_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    points = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    marks = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("ts").alias("next_purchase"))
    return lookups.as_of(points, marks, ["user_id"], "ts", "at", "next_purchase").drop("ts")


@query("priority_merge", """select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v from (select c_nationkey as k, max(c_acctbal) as v from customer where c_acctbal > 9950 group by 1) a full outer join (select s_nationkey as k, max(s_acctbal) as v from supplier group by 1) b on a.k = b.k""")
def priority_merge(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9950").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    return lookups.merged(a, b, "k", "v")


@query("set_operations", """select 'union' as op, count(*) as n from (select c_nationkey as k from customer union select s_nationkey from supplier) union all select 'difference', count(*) from (select n_nationkey from nation except select s_nationkey from supplier where s_acctbal > 5000) union all select 'distinct', count(*) from (select distinct c_nationkey, c_mktsegment from customer)""")
def set_operations(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    parts = {"union": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(), "difference": lookups.lacking(n, s.filter("s_acctbal > 5000"), {"n_nationkey": "s_nationkey"}), "distinct": c.select("c_nationkey", "c_mktsegment").dropDuplicates()}
    return reduce(DataFrame.unionByName, [d.agg(F.lit(k).alias("op"), F.count("*").alias("n")) for k, d in parts.items()])


@query("similar_vectors", """select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > 0.5 as similar, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def similar_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    c = lm.cosine(F.col("a"), F.col("b"))
    return pairs.select("vec_id", (c > 0.5).alias("similar"), F.round(c, 6).alias("cosine"))


# --- language model, aggregations


@query("token_unigrams", f"select word, count(*) as c from (select unnest({WORDS_SQL}) as word from documents) group by word")
def token_unigrams(spark, sf_dir):
    return lm.unigrams(table(spark, sf_dir, "documents").select(words_of(F.col("text")).alias("words")))


@query("word_bigrams", f"""with w as (select doc_id, unnest({WORDS_SQL}) as word, generate_subscripts({WORDS_SQL}, 1) as idx from documents), m as (select doc_id, word, lag(word) over (partition by doc_id order by idx) as prev, lead(word) over (partition by doc_id order by idx) as nxt from w)
select prev, word, count(*) as c from (select coalesce(prev, '<s>') as prev, word from m union all select word, '</s>' from m where nxt is null union all select '<s>', '</s>' from documents where len({WORDS_SQL}) = 0) group by 1, 2""")
def word_bigrams(spark, sf_dir):
    return lm.grams(table(spark, sf_dir, "documents").select(words_of(F.col("text")).alias("words")))


@query("bigram_perplexity", f"""with d as (select doc_id as item_id, {WORDS_SQL} as words from documents), w as (select item_id, unnest(list_concat(['<s>'], words)) as prev, unnest(list_concat(words, ['</s>'])) as word from d),
g as (select prev, word, count(*) as c from w group by 1, 2), p as (select prev, sum(c) as total from g group by 1), v as (select count(distinct word) as n from g)
select w.item_id as doc_id, count(*) - 1 as n, round(pow(10, -sum(log10((g.c + 0.1) / (p.total + 0.1 * v.n))) / count(*)), 6) as ppl from w join g using (prev, word) join p using (prev), v group by 1""")
def bigram_perplexity(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("words"))
    return lm.corpus_perplexity(items, lm.grams(items), ["doc_id"]).select("doc_id", F.col("n"), F.round("ppl", 6).alias("ppl"))


@query("single_letter_runs", f"""with w as (select doc_id, unnest({WORDS_SQL}) as word, generate_subscripts({WORDS_SQL}, 1) - 1 as idx from documents), b as (select *, sum(case when length(word) = 1 then 0 else 1 end) over (partition by doc_id order by idx) as grp from w), r as (select doc_id, grp, min(idx) as run, count(*) as n from b where length(word) = 1 group by 1, 2 having count(*) >= 2)
select doc_id, count(*) as runs, max(n) as longest, min(run) as first_run from r group by 1""")
def single_letter_runs(spark, sf_dir):
    found = split.runs(document_words(spark, sf_dir), ["doc_id"], "idx", F.length("word") == 1)
    each = found.groupBy("doc_id", "run").agg(F.max("run_length").alias("n"))
    return each.groupBy("doc_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.min("run").cast("bigint").alias("first_run"))


@query("frequency_filter", f"""with w as (select doc_id, word, count(*) as n from (select doc_id, unnest({WORDS_SQL}) as word from documents) group by 1, 2) select doc_id, count(*) filter (where n > 2) as repeated, coalesce(sum(n) filter (where n <= 2), 0)::bigint as kept from w group by 1""")
def frequency_filter(spark, sf_dir):
    counted = document_words(spark, sf_dir).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.count_if(F.col("n") > 2).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") <= 2, F.col("n"))), F.lit(0)).alias("kept"))


_KEY = "regexp_replace(word, '[aeiou]', '', 'g')"


@query("majority_spelling", f"""with w as (select doc_id, word, count(*) as n, min(idx) as first from (select doc_id, unnest({WORDS_SQL}) as word, generate_subscripts({WORDS_SQL}, 1) as idx from documents) where length(word) >= 4 group by 1, 2),
r as (select *, {_KEY} as key, row_number() over (partition by doc_id, {_KEY} order by n desc, first desc) as rn, count(*) over (partition by doc_id, {_KEY}) as k from w)
select doc_id, key, word as winner from r where rn = 1 and k > 1""")
def majority_spelling(spark, sf_dir):
    words = document_words(spark, sf_dir).filter(F.length("word") >= 4)
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("idx").alias("first")).withColumn("key", F.regexp_replace("word", "[aeiou]", ""))
    return entities.majority(counted, "key")


@query("entity_counts", """select o_custkey % 50 as doc_id, o_orderpriority as word, count(*) as n, min(o_orderkey) as first from orders group by 1, 2""")
def entity_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), F.lit(0).alias("cls"), F.col("o_orderpriority").alias("word"), F.col("o_orderkey").alias("pos"))
    return entities.counts(rows).select("doc_id", "word", "n", "first")


@query("metric_rollup", """select time_bucket(interval '1 hour', ts) as window_start, event_type as metric, round(sum(value), 6) as total, round(avg(value), 6) as mean, max(value) as high, min(value) as low, median(value) as middle, arg_max(value, (ts, value)) as last from events where value is not null group by 1, 2""".replace("time_bucket(interval '1 hour', ts)", "date_trunc('hour', ts)"))
def metric_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    points = e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("app").alias("app_mark"), F.lit("i").alias("instance_mark"), F.create_map().cast("map<string,string>").alias("tags"), F.col("event_type").alias("metric"), F.explode(F.array(*[F.lit(m) for m in metrics.METHODS])).alias("method"), F.col("value").cast("string").alias("value"))
    rolled = metrics.rolled_up(points, "1 hour")
    names = {"ADD": "total", "AVG": "mean", "MAX": "high", "MIN": "low", "MIDDLE": "middle", "NONE": "last"}
    out = rolled.groupBy("window_start", "metric").pivot("method", list(names)).agg(F.first("value"))
    return out.withColumnsRenamed(names).withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6), "mean": F.round("mean", 6)})


@query("request_kpis", """select event_type, count(*) as requests, count(*) filter (where code < 0) as failures, count(*) filter (where ms > 5000) as timeouts, count(*) filter (where ms > 1200) as slow, round(avg(ms), 6) as mean_ms, count(model_ms) as model_calls, count(*) filter (where model_ms > 50) as slow_model_calls
from (select event_type, case when event_id % 97 = 0 then -1 else 0 end as code, value * 100 as ms, case when event_id % 3 = 0 then value end as model_ms from events) group by 1""")
def request_kpis(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 97 == 0, -1).otherwise(0).alias("code"), (F.col("value") * 100).alias("ms"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("model_ms"))
    return metrics.kpis(e, ["event_type"]).withColumn("mean_ms", F.round("mean_ms", 6))


# --- ordered state, top-k


@query("carried_state", """with s as (select conv_id, turn, case when role = 'user' then 1 else 0 end as names, case when role = 'user' then 1 + conv_id % 2 end as gender, case when text like '%the%' then 1 else 0 end as he, case when length(text) % 2 = 0 then 1 else 0 end as she from conversations),
t as (select *, case when names = 1 then gender end as own from s), u as (select *, coalesce(own, lag(own) over (partition by conv_id order by turn)) as g from t)
select conv_id, turn, coalesce(g, -1)::int as sentence_gender, coalesce(g in (1, 2) and not (he = 0 or she = 0), false) as fires from u""")
def carried_state(spark, sf_dir):
    c, user = table(spark, sf_dir, "conversations"), F.col("role") == "user"
    rows = c.select(
        "conv_id", "turn", F.when(user, 1).otherwise(0).alias("names"), F.when(user, 1).otherwise(0).alias("gendered"), F.when(user, 1 + F.col("conv_id") % 2).cast("int").alias("gender"), F.lit(0).alias("men"), F.lit(0).alias("women"),
        F.when(F.contains("text", F.lit("the")), 1).otherwise(0).alias("he"), F.when(F.length("text") % 2 == 0, 1).otherwise(0).alias("she"),
    )
    return entities.carried(rows, ("conv_id",), "turn").select("conv_id", "turn", F.coalesce("sentence_gender", F.lit(-1)).alias("sentence_gender"), "fires")


@query("top_sentences", f"with {_SENTENCES_SQL} select doc_id, para, pos, rn as rank, length(sentence) as chars from (select *, row_number() over (partition by doc_id order by length(sentence) desc, para, pos) as rn from (select *, row_number() over (partition by doc_id order by para, pos) as pos2 from sents)) where rn <= 5".replace("select doc_id, para, pos, rn", "select doc_id, para, pos2 as sno, rn"))
def top_sentences(spark, sf_dir):
    s = sentences(spark, sf_dir).withColumn("chars", F.length("sentence").cast("bigint"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "sno")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("doc_id", F.col("para").cast("bigint").alias("para"), F.col("sno").cast("bigint").alias("sno"), F.col("rank").cast("bigint").alias("rank"), "chars")


@query("first_by_position", """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""")
def first_by_position(spark, sf_dir):
    return lookups.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("most_frequent_values", """with f as (select l_partkey as word, count(*) as freq from lineitem group by 1), p as (select p_brand, p_partkey from part) select p_brand, p_partkey, freq from (select p_brand, p_partkey, coalesce(freq, 0) as freq, row_number() over (partition by p_brand order by coalesce(freq, 0) desc, p_partkey) as rn from p left join f on p_partkey = word) where rn <= 10""")
def most_frequent_values(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("word")).agg(F.count("*").alias("freq"))
    return lookups.most_frequent(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), f, "p_brand", "p_partkey").select("p_brand", "p_partkey", "freq")


# --- levels and verdicts


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in the engine's shape from order lines: a document is an order, its type cycles through the known ones."""
    kinds = F.array(*[F.lit(k) for k in (0, 1, 51, 2, 3, 4, 10, 11, 20)])
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("sno"), F.element_at(kinds, (F.col("l_partkey") % 9 + 1).cast("int")).alias("type"), (F.col("l_discount") * 10).alias("prob"), F.col("l_returnflag").alias("wrong"), F.lit(0).alias("recall"), (F.col("l_orderkey") % 5 == 0).cast("int").alias("data_type"))


_ERRORS_SQL = """e0 as (select l_orderkey as doc_id, l_linenumber - 1 as sno, ([0, 1, 51, 2, 3, 4, 10, 11, 20])[l_partkey % 9 + 1] as type, l_discount * 10 as prob, l_returnflag as wrong, case when l_orderkey % 5 = 0 then 1 else 0 end as data_type from lineitem),
e1 as (select *, count(*) over (partition by doc_id, wrong) as n from e0), e2 as (select *, case when n > 2 then 1 else 0 end as recall from e1 where n <= 2 or type in (0, 7, 9, 10, 15, 57)),
th(type, precise, delay) as (values (0, 0.0, 0.0), (1, 0.65, 0.7), (51, 0.8, 0.5), (2, 0.85, 0.6), (3, 0.9, 0.5), (4, 0.9, 0.5), (10, 0.5, 0.2), (11, 0.7, 0.5), (20, null, 0.9)),
e3 as (select e2.*, (prob < coalesce(precise, 1.0)::double or recall = 1) as low, coalesce(delay, 0.2)::double as delay from e2 left join th using (type)),
details as (select *, case when data_type = 0 and not low then 2 else 1 end as level, case when data_type = 0 and low and prob >= delay then 1 else 0 end as pop from e3)"""


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.levelled(resolve.frequent_dropped(_errors(spark, sf_dir)), resolve.threshold_table(spark))


@query("error_levels", f"with {_ERRORS_SQL} select type::int as type, level::int as level, pop::int as pop, count(*) as n from details group by 1, 2, 3")
def error_levels(spark, sf_dir):
    return _levelled(spark, sf_dir).groupBy("type", "level", "pop").agg(F.count("*").alias("n"))


@query("document_verdicts", f"""with {_ERRORS_SQL}, d as (select doc_id, count(*) filter (where sno = 0) as title_num, count(*) filter (where sno <> 0) as fst_num, count(*) as all_num, sum(case when level = 2 then case when sno = 0 then 3 else 1 end else 0 end) as score, sum(case when pop = 1 then case when sno = 0 then 3 else 1 end else 0 end) as pops, max(case when level = 1 and sno = 0 then 1 else 0 end) as t, max(data_type) as k from details group by 1)
select doc_id, title_num::int as title_num, fst_num::int as fst_num, all_num::int as all_num, (case when score >= 3 then 2 when all_num >= 3 or (k = 1 and all_num > 0) or t = 1 then 1 else 0 end)::int as typo_level, (case when pops >= 3 then 1 else 0 end)::int as typo_pop_result from d""")
def document_verdicts(spark, sf_dir):
    return resolve.verdicts(_levelled(spark, sf_dir))


@query("label_levels", """select quality, toxic, count(*) as n, max(case when quality = 1 then 0.9 else 0.4 end)::double as threshold from labels group by 1, 2""")
def label_levels(spark, sf_dir):
    th = spark.createDataFrame([(1, 0.9)], "q int, high double")
    rows = lookups.lookup(table(spark, sf_dir, "labels"), th, {"quality": "q"}, "left")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.max(F.coalesce("high", F.lit(0.4))).alias("threshold"))


# --- what needs Chinese text: small fixtures

FIXTURE_READINGS = {"北": "bei", "京": "jing", "是": "shi", "时": "shi", "手": "shou", "首": "shou", "都": "du", "票": "piao", "量": "liang", "漂": "piao", "亮": "liang", "很": "hen", "女": "nv", "朋": "peng", "友": "you", "他": "ta", "她": "ta", "男": "nan", "帅": "shuai", "旗": "qi", "气": "qi", "归": "gui", "整": "zheng", "柜": "gui", "正": "zheng"}
FIXTURE_TEXTS = ["北京 是 首都", "北京 是 中国 的 首都", "他 男朋友 很 帅气", "他 女朋友 很 漂亮", "女朋友 很 漂亮", "男朋友 帅气", "北京 很 大", "中国 的 首都 是 北京"]
FIXTURE_WORDS = {"北京", "首都", "中国", "男朋友", "女朋友", "帅气", "帅旗", "漂亮"}


def fixture_models(spark: SparkSession):
    from quillspark.plans.check import Models

    train = spark.createDataFrame([(t.split(),) for t in FIXTURE_TEXTS * 20], "words array<string>")
    model = lm.PairModel.of(lm.grams(train))
    table_of = lambda rows, schema: spark.createDataFrame(rows, schema)
    lex = detect.Lexicons(
        same_sound=table_of([("手", "首", 0), ("时", "是", 0), ("帅旗", "帅气", 0)], "word string, cand string, rank int"),
        common=table_of([("piao liang", "漂亮", 0)], "py string, word string, rank int"),
        top_words=table_of([("首都",), ("北京",)], "word string"),
    )
    return Models(segment=split.segmenter(FIXTURE_WORDS), perplexity=model.ppl, lexicons=lex, readings=FIXTURE_READINGS)


@query("typo_check", """select * from (values ('d1', 0, 3, '手', '首', 1), ('d2', 0, 2, '时', '是', 2), ('d3', 0, 7, '旗', '气', 3)) as t(doc_id, sno, idx, wrong, correct, typo)""")
def typo_check(spark, sf_dir):
    from quillspark.plans.check import check
    from quillspark.sources.documents import shaped

    docs = shaped(spark.createDataFrame([("d1", "北京是手都"), ("d2", "北京时中国的首都"), ("d3", "他的男朋友很帅旗"), ("d4", "北京是首都")], "doc_id string, title string"))
    return check(docs, fixture_models(spark))[0].select("doc_id", "sno", "idx", "wrong", "correct", "typo")


@query("script_conversion")
def script_conversion(spark, sf_dir):
    from quillspark.functions.variants import converter

    entries = spark.createDataFrame([("發", "发"), ("國", "国"), ("頭髮", "头发"), ("髮", "发"), ("頭", "头"), ("皇后", "皇后"), ("後", "后")], "source string, target string")
    rows = spark.createDataFrame([(1, "發展中國家"), (2, "頭髮"), (3, "皇后")], "id int, t string")
    return rows.select("id", converter(entries)("t").alias("simple"))


@query("word_pieces")
def word_pieces(spark, sf_dir):
    from quillspark.functions.wordpiece import tokenizer

    vocabulary = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"], "the", "##ing", "##tion", "on"])}
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(vocabulary)("text").alias("pieces")).select("item_id", F.size("pieces").alias("n"), F.array_join("pieces", " ").alias("pieces"))


@query("metric_stream", """select date_trunc('hour', ts) as window_start, event_type as metric, round(sum(value), 6) as value from events where value is not null and date_trunc('hour', ts) + interval '1 hour' <= (select max(ts) from events) group by 1, 2""")
def metric_stream(spark, sf_dir):
    """The hourly roll-up by a stream that reads the same table: all windows that the watermark has passed."""
    import uuid

    at = f"{shared_dir(spark)}/metric-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    points = e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("app").alias("app_mark"), F.lit("i").alias("instance_mark"), F.create_map().cast("map<string,string>").alias("tags"), F.col("event_type").alias("metric"), F.lit("ADD").alias("method"), F.col("value").cast("string").alias("value"))
    rolled = metrics.rolled_up(points, "1 hour", "0 seconds")
    query = metrics.sink(rolled, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state", available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric", F.round("value", 6).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, caps and words of every document in one pass, and what they add up to."""
    s = sentences(spark, sf_dir, split.MAX_CHARS, split.MAX_SENTENCES).withColumn("words", split.latin_words(F.col("sentence")))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest"))
