"""What the operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, in the order of its code points.
ASCII_SPACE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if spark.sparkContext.master.startswith("local"):  # one machine: the warehouse is a folder that all of it shares
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and its rows are computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that no plan reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most `rows` rows, as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


_CACHES: dict[str, Callable[[], None]] = {}
_USED: list[str] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say in a worker that an operator uses its cache now: the caches that other operators left there are cleared."""
    _CACHES[name] = clear
    if _USED != [name]:
        for other, drop in _CACHES.items():
            if other != name:
                drop()
        _USED[:] = [name]


#: Most rows of a batch that goes to a Python worker.
BATCH_ROWS = 2000


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as plans are made and run inside; then it is as it was."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def small_batches(operator: Callable) -> Callable:
    """Of an operator on a DataFrame: its Python stages, which all run before it returns, get batches of BATCH_ROWS rows.

    With whole texts, Spark's default of 10000 rows is too much memory for a worker.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **options):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(df.sparkSession.conf.get(key, "10000"))
        with setting(df.sparkSession, key, str(now if 0 < now <= BATCH_ROWS else BATCH_ROWS)):
            return operator(df, *args, **options)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() has a fast path for ASCII texts and does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Of an array the fold of each entry with all before it by an associative step.

    Round k folds every entry with the one 2**k before it, so an array of n entries takes log2(n) passes: a fold that grows
    an array by one entry at a time would copy it n times.
    """

    def all_rounds(x: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int"))

        def folded(acc: Column, k: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda v, i: F.when(i >= back, step(F.get(acc, i - back), v)).otherwise(v))

        return F.aggregate(rounds, x, folded)

    return let(values, all_rounds)
