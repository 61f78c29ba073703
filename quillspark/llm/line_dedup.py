"""Line dedup over levelled sorted runs of line hashes, in native DataFrame operations only.

Documents come in batches by rising doc_id. A run holds (h1, h2, owner): 128 bits of a line's key and the smallest doc_id
that has it, as a table whose buckets are hash partitions of the key, each one file in its order. A batch is bucketed alike
and merge-anti-joins the runs, which are neither shuffled nor sorted again: keys of theirs are old, the others are its own
and make a new run at level 0. When a level has `fanout` runs they are merged into one of the next level, so a line's hash
is rewritten once a level: log(batches) times, not once a batch. A folder keeps the runs and the list of them, so a later
session opens it and adds its batches.

A key's owner is found with partial aggregation before the shuffle, so a line that a third of the rows hold is a few rows.
Only hashes travel until the verdicts are known; texts are shuffled once, to meet the verdicts on their own lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ASCII_SPACE, ascii_lower, let, partitions, running, setting, shared_dir, written

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 3
KEY = ["h1", "h2"]
#: Lost keys of a document up to which each of its lines is compared with each of them.
FEW_LOST = 16
#: Seed of the second hash.
SECOND = "second line hash"


def line_keys(lines: Column) -> Column:
    """Of an array of lines: each with ASCII white space stripped at both ends and A-Z lower-cased. Step by step, as a lambda evaluates what it mentions twice twice."""
    return F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(ASCII_SPACE))), ascii_lower)


def _hashed(key: Column) -> Column:
    """128 bits of a key; null for keys too short to count."""
    return F.when(F.length(key) >= LEAST_CHARS, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SECOND), key).alias("h2")))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


_RUN = "h1 long, h2 long, owner long, many boolean"
#: A bucketed file is read in its order only with this setting; each bucket here is one file.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: With this setting a union of bucketed tables counts as bucketed, though its rows are written in more files than buckets.
_UNION = "spark.sql.unionOutputPartitioning"


class LineRuns:
    """The levelled runs. add() returns what it can say of a batch: rows (h1, h2, owner) of keys that have an earlier or another holder.

    folder: where runs and their list are kept; opened again, it goes on where the last saved list left off. Without one the
    runs go to the shared folder and no list is kept.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None, folder: str | None = None):
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        if folder:
            self._open()

    def _open(self) -> None:
        """The newest list in the folder; runs that it lacks are leftovers of a batch that didn't end."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/list-*/_SUCCESS")
        lists = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        self.version = max((int(x.getPath().getParent().getName()[5:]) for x in lists or []), default=0)
        if not self.version:
            return
        for r in sorted(self.spark.read.json(f"{self.folder}/list-{self.version}").collect(), key=lambda r: (r["level"], r["place"])):
            self.buckets = r["buckets"]
            self.paths[r["name"]] = r["path"]
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            self.levels[r["level"]].append(r["name"])
            self.spark.sql(f"create table if not exists {r['name']} ({_RUN}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{r['path']}'")

    def _save(self) -> None:
        rows = [(level, place, name, self.paths[name], self.buckets) for level, names in enumerate(self.levels) for place, name in enumerate(names)]
        self.version += 1
        self.spark.createDataFrame(rows, "level int, place int, name string, path string, buckets int").coalesce(1).write.json(f"{self.folder}/list-{self.version}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for names in self.levels for name in names]

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: rows (h1, h2, owner, many): a key, its smallest doc_id in this batch, whether other documents of it hold the key."""
        new, old = batch, []
        with setting(self.spark, _ORDERED, "true"):
            for run in self.runs():
                known = run.select(*KEY, F.col("owner").alias("first"))
                old.append(new.hint("merge").join(known, KEY).select(*KEY, F.col("first").alias("owner")))
                new = new.hint("merge").join(known, KEY, "left_anti")
            fresh = self._sorted(new.select(*KEY, "owner", "many"), 0)
            out = self.spark.table(fresh).filter("many").select(*KEY, "owner")
            for x in old:
                out = out.unionByName(x)
            out = written(out, "line-verdicts")
            stale = self._push(0, fresh)
        if self.folder:
            self._save()
        for name in stale:
            self._drop(name)
        return out

    def _sorted(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        self.paths[name] = f"{self.folder or shared_dir(self.spark)}/{name}"
        bucketed(rows, self.buckets).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _push(self, level: int, run: str) -> list[str]:
        """Adds a run, merging levels that are full. The runs that were merged, which are no longer needed."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return []
        merged, self.levels[level] = self.levels[level], []
        rows = self.spark.table(merged[0])
        for name in merged[1:]:
            rows = rows.unionByName(self.spark.table(name))
        with setting(self.spark, _UNION, "false"):
            run = self._sorted(rows, level + 1)
        return merged + self._push(level + 1, run)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        """Deletes the runs."""
        for name in [name for names in self.levels for name in names]:
            self._drop(name)
        self.levels = []


def bucketed(rows: DataFrame, buckets: int):
    """A writer of rows by buckets of their keys, one file each, in order."""
    return rows.repartition(buckets, *KEY).sortWithinPartitions(*KEY).write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Least doc_id of each batch but the first: quantiles of all ids. Where they lie sets the batches' sizes, not the result."""
    found = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(x) for x in found})


def verdicts(docs: DataFrame, text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Rows (doc_id, h): the hashed keys that a document loses."""
    lo = _bounds(docs.select("doc_id").filter("doc_id is not null"), batches)
    number = F.lit(0)
    for x in lo:
        number = number + (F.col("doc_id") >= x).cast("int")
    held = docs.filter("doc_id is not null").select("doc_id", number.alias("batch"), F.explode(F.array_distinct(F.transform(line_keys(_lines(text)), _hashed))).alias("h"))
    held = written(held.filter("h is not null").select("doc_id", "batch", "h.h1", "h.h2"), "line-hashes")
    spark = docs.sparkSession
    runs, out = LineRuns(spark, fanout), None
    name = f"line_keys_{uuid.uuid4().hex}"
    keys = held.groupBy("batch", *KEY).agg(F.min("doc_id").alias("owner"), (F.min("doc_id") != F.max("doc_id")).alias("many"))
    bucketed(keys, runs.buckets).partitionBy("batch").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    runs.paths[name] = f"{shared_dir(spark)}/{name}"
    for b in range(len(lo) + 1):
        said = runs.add(spark.table(name).filter(F.col("batch") == b).drop("batch")).withColumn("batch", F.lit(b))
        out = said if out is None else out.unionByName(said)
    runs._drop(name)
    runs.close()
    lost = held.join(out, ["batch", *KEY]).filter(F.col("doc_id") != F.col("owner"))
    return lost.select("doc_id", F.struct(*KEY).alias("h"))


def dedup_lines(docs: DataFrame, text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with columns n_lines (before dropping), n_dropped and kept: the lines that stay, joined by a line feed.

    A key of at least 10 code points that two or more documents hold loses all its lines except those in the smallest
    doc_id that holds it. Rows that share a doc_id are one document here. Null and empty texts are one empty line. Rows
    with a null doc_id neither lose lines nor take them from others. Other columns pass through, but for those with the names
    of the new ones.
    """
    docs = docs.drop("_id", "_lost", "_kept", "n_lines", "n_dropped", "kept")
    lost = verdicts(docs, text, batches, fanout).groupBy("doc_id").agg(F.collect_set("h").alias("_lost")).withColumnRenamed("doc_id", "_id")
    joined = docs.join(lost, docs["doc_id"] == lost["_id"], "left").drop("_id")
    lines = _lines(text)
    # each line beside its hash, so that the lambda mentions neither expression: the optimizer would put it in and evaluate it once a line
    paired = F.zip_with(lines, F.transform(line_keys(lines), _hashed), lambda x, h: F.struct(x.alias("x"), h.alias("h")))
    few = F.filter(paired, lambda p: ~F.coalesce(F.array_contains(F.col("_lost"), p["h"]), F.lit(False)))
    kept = F.when(F.col("_lost").isNull(), lines).when(F.size("_lost") <= FEW_LOST, F.transform(few, lambda p: p["x"])).otherwise(_without(paired, F.col("_lost")))
    return joined.withColumns({"n_lines": F.size(lines).cast("bigint"), "_kept": kept}).withColumns({"n_dropped": F.col("n_lines") - F.size("_kept"), "kept": F.array_join("_kept", "\n")}).drop("_lost", "_kept")


def _without(paired: Column, lost: Column) -> Column:
    """The lines (x, h) whose hash isn't in `lost`, as texts: both sides are sorted together by hash, and a line goes if the last lost hash before it is its own."""
    marks = F.transform(lost, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("at")))
    places = F.filter(F.transform(paired, lambda p, i: F.struct(p["h"].alias("h"), i.alias("at"))), lambda v: v["h"].isNotNull())

    def gone(events: Column) -> Column:
        last = running(F.transform(events, lambda v, i: F.when(v["at"] < 0, i).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b))
        met = F.zip_with(events, last, lambda v, n: F.struct(v["at"].alias("at"), (F.get(events, n)["h"] == v["h"]).alias("same")))
        return F.transform(F.filter(met, lambda m: (m["at"] >= 0) & F.coalesce(m["same"], F.lit(False))), lambda m: m["at"])

    out = let(F.sort_array(F.concat(marks, places)), gone)
    return let(paired, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), out), lambda i: F.get(x, i)["x"]))


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest().
SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
owners as (select k, min(doc_id) as owner from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select keyed.*, owner is not null and owner <> doc_id as lost from keyed left join owners using (k))
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""
