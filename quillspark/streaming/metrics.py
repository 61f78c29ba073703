"""Operational metrics: roll-ups by window and series, the same in batch and in a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "ts timestamp, app_mark string, instance_mark string, tags map<string,string>, metric string, method string, value string"
# How a metric's points of a window become one.
METHODS = ("NONE", "ADD", "AVG", "MAX", "MIN", "MIDDLE")
SERIES_PER_PACKAGE, SEQUENCE_WRAP, TRIES = 1000, 1_000_000_000, 3
SLOW_MS, TIMEOUT_MS, MODEL_SLOW_MS = 1200, 5000, 50


def rolled_up(points: DataFrame, width: str = "1 second", watermark: str | None = None) -> DataFrame:
    """window_start, app_mark, instance_mark, tags, metric, method, value.

    Values that are no numbers are left out. NONE is the last value by ts, ties to the larger; MIDDLE is the median. A
    stream needs a watermark: points later than that are dropped, which batch never does.
    """
    p = points.withColumn("value", F.expr("try_cast(value as double)")).filter("value is not null")
    p = p.withWatermark("ts", watermark) if watermark else p
    # maps can't be keys: a series' tags are their sorted entries as JSON
    p = p.withColumn("tags", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))))
    keys = [F.window("ts", width).alias("w"), "app_mark", "instance_mark", "tags", "metric", "method"]
    out = p.groupBy(*keys).agg(
        F.sum("value").alias("a"), F.avg("value").alias("b"), F.max("value").alias("c"), F.min("value").alias("d"), F.percentile("value", F.lit(0.5)).alias("e"), F.max_by("value", F.struct("ts", "value")).alias("f")
    )
    value = F.when(F.col("method") == "ADD", F.col("a")).when(F.col("method") == "AVG", F.col("b")).when(F.col("method") == "MAX", F.col("c")).when(F.col("method") == "MIN", F.col("d")).when(F.col("method") == "MIDDLE", F.col("e")).otherwise(F.col("f"))
    return out.select(F.col("w.start").alias("window_start"), "app_mark", "instance_mark", "tags", "metric", "method", value.alias("value"))


def kpis(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: requests, failures (code below 0), timeouts, slow ones, mean delay, model calls and slow model calls. requests: code, ms, model_ms (null: none)."""
    return requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(F.col("code") < 0).alias("failures"), F.count_if(F.col("ms") > TIMEOUT_MS).alias("timeouts"), F.count_if(F.col("ms") > SLOW_MS).alias("slow"),
        F.avg("ms").alias("mean_ms"), F.count("model_ms").alias("model_calls"), F.count_if(F.col("model_ms") > MODEL_SLOW_MS).alias("slow_model_calls"),
    )


def packaged(series: DataFrame, keys: list[str], size: int = SERIES_PER_PACKAGE) -> DataFrame:
    """series with package: at most about `size` series each, by a hash of their keys, so that none is numbered in one task."""
    n = max(1, -(-series.count() // size))
    return series.withColumn("package", F.pmod(F.xxhash64(*keys), F.lit(n)))


def source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(METRIC).option("maxFilesPerTrigger", files_per_batch).json(path)


def sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, tries: int = TRIES, available_now: bool = False):
    """Starts a query that hands each batch of finished windows to `write`, which is tried again if it fails. Batches have ids: a writer that knows them writes once."""

    def attempt(batch: DataFrame, number: int) -> None:
        for left in reversed(range(tries)):
            try:
                write(batch, number % SEQUENCE_WRAP)
                return
            except Exception:
                if not left:
                    raise

    out = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(attempt)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 second")).start()


class Health:
    """Counts rows of a query's progress reports; plug into spark.streams.addListener through listener()."""

    def __init__(self):
        self.batches = self.rows = self.failures = 0

    def listener(self):
        from pyspark.sql.streaming import StreamingQueryListener

        health = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                health.batches += 1
                health.rows += event.progress.numInputRows

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                health.failures += event.exception is not None

        return Listener()
