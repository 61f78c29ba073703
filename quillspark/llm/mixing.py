"""Mixing of sources to target weights by Poisson replication, in native expressions.

A source's rate is the mean number of copies that brings it to its target weight. A document's number of copies is the inverse
of the Poisson distribution with that rate at a number in (0, 1) that a seeded hash of its id gives: the same in every run, on
any cluster, in any order. A rate above PART_RATE is the sum of equal smaller ones, and so is the number of copies the sum of
as many inverses, each of a hash of its own: exactly as distributed, and no table of chances is longer than a small rate's.
Copies are exploded and shuffled globally: dealt out by a hash of (seed, id, copy) and ordered by it within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, written

SEED = "mix-1"
#: Exponent of a source's share of documents in its default weight: 1 keeps shares, 0 makes them equal.
TEMPERATURE = 0.5
#: Mean copies of a document over all sources.
EPOCHS = 1.0
#: Rates above this are split into equal ones that are not: a table of chances has under 120 entries whatever the rate.
PART_RATE = 32.0
#: Sources up to which the table of rates is broadcast, at a kilobyte each or less; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000
#: Bits of the uniform numbers: 13 hexadecimal digits of a hash.
BITS = 52


def uniform(id: Column, seed: str, part: Column) -> Column:
    """A number in (0, 1) from a hash of the seed, the part and the id; a null id counts as ''. Part 0 leaves no trace in what is hashed."""
    name = F.concat(F.lit(seed), F.when(part > 0, F.concat(F.lit("/"), part.cast("string"))).otherwise(F.lit("")), F.lit(":"), F.coalesce(id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << BITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """source, n, rate, parts, below: the mean copies of a source's documents, how many equal rates it is the sum of, and the chances of at most 0, 1, 2, ... copies at one of these.

    weights: target shares by source; sources that it lacks get none. By default a source's weight is its number of documents
    to the power `temperature`. The list of chances ends where a hash can't reach.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighted = counts.join(given, counts["source"].eqNullSafe(given["name"]), "left").drop("name").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = weighted.agg(F.sum("n").alias("all"), F.sum("w").alias("sum"))
    # one row beside every source
    rated = weighted.join(F.broadcast(total), F.lit(True)).withColumn("rate", F.when(F.col("sum") > 0, F.lit(epochs) * F.col("all") * F.col("w") / F.col("sum") / F.col("n")).otherwise(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("bigint")).withColumn("r", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("r") + 12 * F.sqrt("r") + 20).cast("int"))
    # the term of k copies from that of k - 1: rate / k times; in logarithms, so that small chances don't underflow
    first = F.struct((-F.col("r")).alias("log"), F.exp(-F.col("r")).alias("sum"), F.array(F.exp(-F.col("r"))).alias("below"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(F.col("r")) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["below"], F.array(total)).alias("below"))

    below = F.when(F.col("r") > 0, F.aggregate(steps, first, step, lambda acc: acc["below"])).otherwise(F.array(F.lit(1.0)))
    return rated.select("source", "n", "rate", "parts", below.alias("below"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs (columns doc_id, source and others), each row as often as its Poisson number says, in global random order.

    More columns: copies (the row's number), copy (from 1), shuffle_key (the order). Rows of number 0 are left out: that is
    the sampling. A null source is a source of its own. Rows that share a doc_id and a source get the same number; so do all
    rows with a null doc_id. Such rows share their keys, but a hash of the whole row deals them out too, so they are no hot
    partition. No documents: no rows. Columns with the names of new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_source", "_below", "_parts", "copies", "copy", "shuffle_key")
    table = written(rates(docs, weights, temperature, epochs), "mix-rates")
    few = table.count() <= BROADCAST_SOURCES
    of = table.select(F.col("source").alias("_source"), F.col("below").alias("_below"), F.col("parts").alias("_parts"))
    joined = docs.join(F.broadcast(of) if few else of, docs["source"].eqNullSafe(of["_source"]))

    def drawn(part: Column) -> Column:
        # the hash is bound to a name, so that it is made once and not for every chance
        return F.get(F.transform(F.array(uniform(F.col("doc_id"), seed, part)), lambda u: F.size(F.filter("_below", lambda x: x < u))), F.lit(0))

    copies = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1), F.lit(0), lambda n, part: n + drawn(part))
    counted = joined.withColumn("copies", copies).drop("_source", "_below", "_parts")
    out = counted.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy")))
    return out.withColumn("shuffle_key", key).repartition(partitions(spark), F.col("shuffle_key"), F.xxhash64(*docs.columns)).sortWithinPartitions("shuffle_key")


def sql(docs: str = "documents", temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> str:
    """DuckDB SQL for mix() with default weights, of any relation with documents' columns."""
    return f"""
with recursive counts as (select source, count(*) as n from {docs} group by source),
rated as (
  select source, {epochs!r}::double * (sum(n) over ()) * pow(n::double, {temperature!r}) / (sum(pow(n::double, {temperature!r})) over ()) / n as whole
  from counts),
split as (select source, greatest(1, ceil(whole / {PART_RATE!r}))::bigint as parts, whole / greatest(1, ceil(whole / {PART_RATE!r})) as rate from rated),
terms as (
  select source, parts, rate, 0 as k, -rate as log, exp(-rate) as below from split
  union all
  select source, parts, rate, k + 1, log + ln(rate) - ln((k + 1)::double), below + exp(log + ln(rate) - ln((k + 1)::double)) from terms where k < ceil(rate + 12 * sqrt(rate) + 20)),
chances as (select source, any_value(parts) as parts, list(below order by k) as below from terms group by source),
drawn as (
  select d.*, list_sum(list_transform(range(0, c.parts), lambda p: len(list_filter(c.below, lambda x: x <
    (('0x' || substr(md5('{seed}' || case when p > 0 then '/' || p::varchar else '' end || ':' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / {float(1 << BITS)!r}))))::int as copies
  from {docs} d join chances c on d.source is not distinct from c.source),
copied as (select *, unnest(range(1, copies + 1))::int as copy from drawn where copies > 0)
select *, md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar) as shuffle_key from copied
"""


SQL = sql()
