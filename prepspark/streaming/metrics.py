"""Live counters over a stream of run events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per window, run and kind; state older than the watermark is dropped.

    ``events(run_id, ts timestamp, kind)``, batch or stream.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "run_id", "kind")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "run_id", "kind", "n")
    )


def stream_run_metrics(events: DataFrame, out: str, checkpoint: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Drain the stream and return the latest count per window, run and kind.

    Update mode emits every changed window at once, so windows the watermark has
    not closed are counted too. Each batch overwrites its own folder.
    """
    counts = windowed_counts(events, window, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table = events.sparkSession.read.schema(T.StructType([*counts.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(out)
    return table.groupBy("window_start", "run_id", "kind").agg(F.max_by("n", "batch_id").alias("n"))
