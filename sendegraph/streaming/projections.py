"""Structured Streaming: projections that fold an event log incrementally.

Each projection keeps its offsets in its own checkpoint, so it resumes where it
stopped and replays nothing; ``availableNow`` takes all there is and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import union_all
from ..operators.events import latest_per_key


def event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """The files of a log as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_now(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available in micro-batches and stop."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_latest(path: str, key: list[str], seq: str, keep: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler that keeps, per key, the event with the greatest sequence in a versioned table.

    Each batch joins the table with the batch's own fold and writes the next
    version beside it; a batch that is replayed writes the same version again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest_per_key(batch, key, seq, keep)
        if batch_id:
            new = latest_per_key(union_all(spark.read.parquet(f"{path}/v{batch_id - 1}"), new), key, seq, keep)
        new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return handle


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last version a fold has written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[1:]) for s in fs.listStatus(p))
    return spark.read.parquet(f"{path}/v{last}")


def split_sinks(routes: dict[str, tuple[object, str]]) -> Callable[[DataFrame, int], None]:
    """A handler that sends one pass over the batch to several tables: name to (condition, path)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for cond, path in routes.values():
            batch.where(cond).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return handle


def window_counts(stream: DataFrame, time: str, kind: str, length: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, events): counts per time window, with a watermark for late events."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp"))
    g = t.withWatermark("_t", late).groupBy(F.window("_t", length), kind).agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").alias("window_start"), kind, "events")


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(key).drop("_t")
