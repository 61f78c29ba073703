"""Document and sentence sources, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, business_id string, title string, body string, channel_id int, channel_name string, data_type int"
#: Kinds of documents.
ARTICLE, SHORT_VIDEO, SMALL_VIDEO = 0, 1, 2
COLUMNS = ("doc_id", "business_id", "title", "body", "channel_id", "channel_name", "data_type")


def shaped(df: DataFrame) -> DataFrame:
    """df with all document columns: what it lacks is '' or 0, and so are nulls."""
    empty = {"channel_id": 0, "data_type": 0}
    return df.select(*[(F.coalesce(F.col(c).cast("int" if c in empty else "string"), F.lit(empty.get(c, ""))) if c in df.columns else F.lit(empty.get(c, ""))).alias(c) for c in COLUMNS])


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return shaped(spark.read.parquet(path))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """One request a line; body_content is the body."""
    return shaped(spark.read.schema(DOCUMENT.replace("body string", "body_content string")).json(path).withColumnRenamed("body_content", "body"))


def parsed_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Documents of a column of JSON requests, as a stream or a queue delivers them; unreadable ones have null ids and are left out."""
    schema = DOCUMENT.replace("body string", "body_content string")
    out = df.select(F.from_json(column, schema).alias("r")).select("r.*").withColumnRenamed("body_content", "body")
    return shaped(out.filter("doc_id is not null"))


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))


def from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, body."""
    return shaped(_tsv(spark, path).filter(F.size("f") >= 3).select(F.col("f")[0].alias("doc_id"), F.col("f")[1].alias("title"), F.col("f")[2].alias("body")))


def from_batch_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Wide lines: columns 0, 7 and 8 are doc_id, title and body of articles of channel 12."""
    return shaped(_tsv(spark, path).filter(F.size("f") >= 9).select(F.col("f")[0].alias("doc_id"), F.col("f")[7].alias("title"), F.col("f")[8].alias("body"), F.lit(12).alias("channel_id")))


def from_video_tsv(spark: SparkSession, path: str) -> DataFrame:
    """First column doc_id, last column title; videos without a body."""
    return shaped(_tsv(spark, path).filter(F.size("f") >= 2).select(F.col("f")[0].alias("doc_id"), F.element_at("f", -1).alias("title"), F.lit(SHORT_VIDEO).alias("data_type")))


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON request files, a bounded number a batch."""
    raw = spark.readStream.schema(DOCUMENT.replace("body string", "body_content string")).option("maxFilesPerTrigger", files_per_batch).json(path)
    return shaped(raw.withColumnRenamed("body_content", "body"))


def one_document(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.filter(F.col("doc_id") == doc_id)


def authorised(docs: DataFrame, user: str = "business_id") -> DataFrame:
    """docs with a column caller: 'module' for ids above 10000, 'product' for 1 to 9999, else null. Never drops a row."""
    number = F.expr(f"try_cast({user} as bigint)")
    return docs.withColumn("caller", F.when(number > 10000, "module").when((number > 0) & (number < 10000), "product"))


def credential_group(docs: DataFrame, groups: dict[str, list[str]], user: str = "business_id") -> DataFrame:
    """docs with a column group: the name of the list that has the caller, else 'other'."""
    out = F.lit("other")
    for name, callers in groups.items():
        out = F.when(F.col(user).isin(callers), name).otherwise(out)
    return docs.withColumn("group", out)


# --- sinks


def with_responses(details: DataFrame, summary: DataFrame) -> DataFrame:
    """A response a document: the summary and its details in order of sentence and place."""
    fields = [c for c in details.columns if c != "doc_id"]
    listed = details.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sno", "idx", *[c for c in fields if c not in ("sno", "idx")]))).alias("details"))
    return summary.join(listed, "doc_id", "left").withColumn("details", F.coalesce("details", F.array()))


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select("doc_id", F.to_json(F.struct(*df.columns)).alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated lines; tabs and line ends in fields become spaces."""
    df.select(F.concat_ws("\t", *[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ") for c in df.columns]).alias("value")).write.text(path)


def write_once(df: DataFrame, path: str, overwrite: bool) -> None:
    """Replaces what is there, or leaves it alone."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
