"""Streams whose state gives the same results as the batch operators (density, beliefs), change feeds, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import weight_of


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_density(effects: DataFrame, function_col: str, kind_col: str, weights: dict[str, int]) -> DataFrame:
    """Running `function, weight, effects, complete`: sums only, so the order of arrival doesn't matter; state is a row a function."""
    return effects.groupBy(function_col).agg(F.sum(weight_of(F.col(kind_col), weights)).cast("long").alias("weight"), F.count("*").alias("effects"), (F.count_if(F.col(kind_col) == "unknown") == 0).alias("complete"))


def stream_beliefs(sites: DataFrame, callee_col: str, checked_col: str) -> DataFrame:
    """Running `callee, sites, checked`; whether it is a belief is decided when read, as counts go on."""
    return sites.groupBy(F.col(callee_col).alias("callee")).agg(F.count("*").alias("sites"), F.count_if(F.col(checked_col)).alias("checked"))


def windowed_rates(events: DataFrame, time_col: str, key_col: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; what comes later than `late` is dropped, and closed windows leave the state."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return events.withWatermark(time_col, late).groupBy(w, key_col).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time_col: str, key_col: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), key_col).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns what its last batch gave, in `complete` mode the whole result.

    Each batch is written as Parquet to a folder of its own under path, which all executors share, so the driver holds no rows and
    a batch that is run again overwrites what it wrote before.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark, last = stream.sparkSession, query.lastProgress
    if last is None:  # nothing was there
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={last['batchId']}")


def change_feed(stream: DataFrame, publish: Callable[[int, DataFrame], None], checkpoint: str, mode: str = "update"):
    """Calls publish(revision, changed rows) for each batch that changes something; revisions begin at 1 and only grow."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            publish(epoch + 1, batch)

    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_work(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose content key has no result yet."""
    return items.join(done.select(key), key, "left_anti")
