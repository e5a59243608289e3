"""Streams over observations and events. The engine's model is batch; these are extensions with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.session import scratch
from saltmarsh.sources.store import SnapshotStore


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Events from a folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of events in event-time windows; events later than the watermark are dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, started, ended, n of runs of events with no gap longer than `gap`."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark, however often it is delivered."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else e.dropDuplicates([key])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process what is there and end: a rerun over the same checkpoint brings only what is new."""
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_sink(store: SnapshotStore, name: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink that keeps the latest row of each key in a snapshot table: a batch written twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        had = store.read(name)
        rows = batch if had is None else had.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys and c != order]
        top = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("t")).select(*keys, "t.*")
        store.write({name: top.select(rows.columns)})

    return write


def run_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", checkpoint: str | None = None) -> DataFrame:
    """The windows of a stream, run to what is there: state and watermark are the stream's own.

    Each batch hands on the windows it changed with their new totals; the last batch that changed a window holds its
    result, so a batch that is delivered twice changes nothing. Windows come out before the watermark closes them, so none
    that is open at the end is missing.
    """
    spark = stream.sparkSession
    out = scratch(spark, "windows")
    q = windowed(stream, late, width).writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"))
    q.option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    shape = "window_start timestamp, event_type string, n long, total double, batch long"
    spark.createDataFrame([], shape).write.parquet(f"{out}/batch=none")  # a stream without events has no batch
    changed = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(out)
    last = F.max(F.struct("batch", "n", "total")).alias("t")
    return changed.groupBy("window_start", "event_type").agg(last).select("window_start", "event_type", "t.n", "t.total")
