"""Lexicon files as typed tables. Lists keep a rank, so that 'first accepted' is defined."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and bytes as rows, up to which a lexicon is handed to every executor; beyond either, joins with it shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 128 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, n: the lines of a file and their order."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))


def numbered(spark: SparkSession, texts: list[str]) -> DataFrame:
    """The same from a list."""
    return spark.createDataFrame(list(enumerate(texts)), "n bigint, line string").select("line", "n")


def _fields(src: DataFrame, separator: str, least: int = 2) -> DataFrame:
    return src.select("n", F.split(F.trim("line"), re.escape(separator), -1).alias("f")).filter(F.size("f") >= least)


def key_value(src: DataFrame, separator: str = "\t") -> DataFrame:
    """key, value: of repeated keys the last line counts."""
    return _fields(src, separator).groupBy(F.trim(F.col("f")[0]).alias("key")).agg(F.max_by(F.trim(F.col("f")[1]), "n").alias("value"))


def key_values(src: DataFrame, separator: str, within: str) -> DataFrame:
    """key, value, rank. With one separator for both, all fields after the first are values. The last line of a key counts."""
    f = _fields(src, separator)
    values = F.slice("f", F.lit(2), F.size("f")) if separator == within else F.split(F.col("f")[1], re.escape(within), -1)
    last = f.groupBy(F.trim(F.col("f")[0]).alias("key")).agg(F.max_by(values, "n").alias("values"))
    return last.select("key", F.posexplode("values").alias("rank", "value")).select("key", F.trim("value").alias("value"), "rank").filter("value <> ''")


def key_values_frequent(src: DataFrame, separator: str, within: str, least: int = 2) -> DataFrame:
    """key, value, count, rank from 'value:count' lists, without values counted less often than `least`."""
    out = key_values(src, separator, within).select("key", "rank", F.split("value", ":").alias("p"))
    return out.select("key", F.col("p")[0].alias("value"), F.expr("try_cast(p[1] as bigint)").alias("count"), "rank").filter(F.col("count") >= least)


def closure(src: DataFrame, separator: str = ",") -> DataFrame:
    """key, value: every member of a line with every other member, over all lines."""
    members = _fields(src, separator).select("n", F.explode("f").alias("key")).select("n", F.trim("key").alias("key")).filter("key <> ''").distinct()
    return members.join(members.withColumnRenamed("key", "value"), "n").filter("key <> value").select("key", "value").distinct()


def line_list(src: DataFrame) -> DataFrame:
    return src.select(F.trim("line").alias("entry"), F.col("n").alias("rank")).filter("entry <> ''")


def first_keys(src: DataFrame, most: int, separator: str = "\t") -> DataFrame:
    """entry: the distinct first fields of the first `most` lines."""
    return src.orderBy("n").limit(most).select(F.trim(F.split("line", re.escape(separator))[0]).alias("entry")).distinct()


def fixed_pairs(src: DataFrame, separator: str = "\t", within: str = "|||") -> DataFrame:
    """side, anchor, py, cand, rank: lines of side, anchor and fields 'py|||cand|||cand...'."""
    f = _fields(src, separator, 3).select(F.col("f")[0].alias("side"), F.col("f")[1].alias("anchor"), F.explode(F.slice("f", F.lit(3), F.size("f"))).alias("x"))
    parts = f.select("side", "anchor", F.split("x", re.escape(within), -1).alias("p"))
    return parts.select("side", "anchor", F.col("p")[0].alias("py"), F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("rank", "cand")).select("side", "anchor", "py", "cand", "rank")


def typed_names(src: DataFrame, separator: str = "\t") -> DataFrame:
    """kind, py, name, rank: lists of repeated keys are joined in the order of lines."""
    f = _fields(src, separator, 3).select("n", F.col("f")[0].alias("kind"), F.col("f")[1].alias("py"), F.posexplode(F.slice("f", F.lit(3), F.size("f"))).alias("pos", "name"))
    return f.select("kind", "py", "name", (F.row_number().over(Window.partitionBy("kind", "py").orderBy("n", "pos")) - 1).alias("rank"))


def video_casts(src: DataFrame, separator: str = "\t", within: str = "|||") -> DataFrame:
    """title, py, name, rank: of lines titles, readings, names; every title with every (reading, name) pair."""
    f = _fields(src, separator, 3).select("n", F.split(F.col("f")[0], re.escape(within)).alias("titles"), F.arrays_zip(F.split(F.col("f")[1], re.escape(within)).alias("py"), F.split(F.col("f")[2], re.escape(within)).alias("name")).alias("cast"))
    each = f.select("n", F.explode("titles").alias("title"), "cast").select("n", "title", F.posexplode("cast").alias("rank", "c"))
    return each.select(F.trim("title").alias("title"), F.col("c.py").alias("py"), F.col("c.name").alias("name"), "rank").filter("py is not null and name is not null")


def polyphones(src: DataFrame, separator: str = ":", within: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(char, reading, rank) of characters with several readings, and (reading, other): readings that share a character."""
    found = key_values(src, separator, within).withColumnsRenamed({"key": "char", "value": "reading"})
    many = found.join(found.groupBy("char").agg(F.count("*").alias("n")).filter("n > 1").select("char"), "char")
    other = many.select("char", "reading").join(many.select("char", F.col("reading").alias("other")), "char").filter("reading <> other")
    return many.select("char", "reading", "rank"), other.select("reading", "other").distinct()


def vocabulary(src: DataFrame) -> DataFrame:
    """token, id: a token's line number from 0; of repeated tokens the last counts. Numbered by a count per partition, not in one task."""
    at = src.select(F.trim("line").alias("token"), "n").withColumn("part", F.shiftright("n", 33))
    sizes = at.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    ids = at.join(before, "part").select("token", (F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    return ids.groupBy("token").agg(F.max("id").alias("id"))


def prefix_keys(words: DataFrame, word: str = "word") -> DataFrame:
    """key, word: two-character prefixes, and two-character suffixes after '_'."""
    keys = F.array(F.substring(word, 1, 2), F.concat(F.lit("_"), F.substring(F.col(word), -2, 2)))
    return words.select(F.explode(keys).alias("key"), F.col(word).alias("word")).distinct()


#: Of lexicons whose size was checked, whether they are small: by their plans, so that one is counted once however often it is looked up.
_CHECKED: dict[int, bool] = {}


def small(lexicon: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """lexicon with a broadcast hint if it has at most `rows` rows and `size` bytes of text, as it is otherwise."""
    key = hash((lexicon.semanticHash(), rows, size))
    if key not in _CHECKED:
        if len(_CHECKED) > 1000:
            _CHECKED.clear()
        width = F.lit(0).cast("bigint")
        for f in lexicon.schema:
            width = width + (F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(16))
        got = lexicon.limit(rows + 1).select(width.alias("w")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
        _CHECKED[key] = got["n"] <= rows and (got["w"] or 0) <= size
    return F.broadcast(lexicon) if _CHECKED[key] else lexicon


def as_map(lexicon: DataFrame, key: str, value: str, rows: int = BROADCAST_ROWS) -> dict:
    """A bounded lexicon as a dict; refuses larger ones."""
    got = lexicon.select(key, value).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    return {r[0]: r[1] for r in got}


def many_key_values(src: DataFrame, separator: str, within: str) -> DataFrame:
    """key, value, rank: every member of a line's first field, parted by `within`, with the values of its second field. The last line of a key counts."""
    f = _fields(src, separator).select("n", F.explode(F.split(F.col("f")[0], re.escape(within), -1)).alias("key"), F.split(F.col("f")[1], re.escape(within), -1).alias("values"))
    last = f.groupBy(F.trim("key").alias("key")).agg(F.max_by("values", "n").alias("values")).filter("key <> ''")
    return last.select("key", F.posexplode("values").alias("rank", "value")).select("key", F.trim("value").alias("value"), "rank").filter("value <> ''")


def settings(src: DataFrame) -> DataFrame:
    """section, name, value of an ini file: of repeated names of a section the last counts. Lines before the first section belong to ''."""
    text = F.trim("line")
    marked = src.withColumn("head", F.when(F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")), F.substring(text, F.lit(2), F.length(text) - 2)))
    # an ini file is a few lines: one ordered pass
    held = marked.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(Window.orderBy("n")), F.lit("")))
    pair = held.filter(F.col("head").isNull() & ~F.regexp(text, F.lit("^[#;]")) & F.contains("line", F.lit("=")))
    pair = pair.select("section", F.trim(F.substring_index("line", "=", 1)).alias("name"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"), "n")
    return pair.groupBy("section", "name").agg(F.max_by("value", "n").alias("value"))
