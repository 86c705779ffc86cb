"""File arrival -> clean -> append, as a stream that drains what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prepspark.functions.columns import col
from prepspark.operators.clean import CleaningFit, apply_cleaning


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def stream_file_ingest(
    stream: DataFrame, out: str, checkpoint: str, fit: CleaningFit, unique: list[str] | None = None, event_time: str | None = None,
    delay: str | None = None, timeout_s: int | None = None,
) -> DataFrame:
    """Clean new files and write each batch below ``out/batch_id=N``; the result does not depend on how files fall into batches.

    The cleaning was fitted on a table and is applied row by row. Rows equal in ``unique`` count once over all batches:
    within ``delay`` of ``event_time`` where these are given (the state is bounded, later rows are dropped), else for ever.
    A batch overwrites its own folder, so a batch replayed after a failure does not appear twice. Returns the table
    written so far.
    """
    cleaned = apply_cleaning(stream, fit)
    if unique and event_time and delay:
        timed = cleaned.withColumn("__at", col(event_time).cast("timestamp")).withWatermark("__at", delay)
        cleaned = timed.dropDuplicatesWithinWatermark(unique).drop("__at")
    elif unique:
        cleaned = cleaned.dropDuplicates(unique)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = cleaned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*cleaned.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(out)
