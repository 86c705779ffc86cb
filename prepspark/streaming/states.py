"""States of runs that follow a stream of stage events, with a timer for runs that fall silent."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prepspark.operators.runs import STAGES

# tasks carry this module's code with them: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATE = "last bigint, times array<bigint>, statuses array<string>"


def stage_events(events: DataFrame) -> DataFrame:
    """The events that count: those with a run, a time and one of the seven stages."""
    return events.where(F.col("run_id").isNotNull() & F.col("ts").isNotNull() & F.col("stage").isin(*STAGES))


def statuses_of(statuses: list[str | None], silent: bool) -> list[str]:
    """Status per stage: a running stage of a silent run has failed, what follows the first failure is pending, as is what never began."""
    out, failed = [], False
    for s in statuses:
        s = "failed" if silent and s == "running" else s or "pending"
        out.append("pending" if failed else s)
        failed = failed or s == "failed"
    return out


def stream_run_states(events: DataFrame, out: str, checkpoint: str, silence: str = "1 hour", delay: str = "1 hour", timeout_s: int | None = None) -> DataFrame:
    """Drain the stream of ``events(run_id, stage, status, ts timestamp)`` and return (run_id, stage, status) of all runs seen.

    The state of a run is the latest event of each stage (ties: the greater status) and the time of its latest event, seven cells
    however many events it has. A run is silent once the watermark (latest event less ``delay``) is more than ``silence`` past its
    latest event; its timer then fails running stages, and a later event revives it. Events may come in any order and batching as long as none
    is more than ``delay`` behind; then the result is that of ``runs.stage_status`` with the watermark as ``as_of``. A status
    that is null counts as pending. Each batch writes its own folder, so a replayed batch replaces it.
    """
    spark = events.sparkSession
    quiet_ms = spark.sql(f"SELECT cast(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {silence}) / 1000 AS bigint)").first()[0]
    run_type = events.schema["run_id"].dataType.simpleString()

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, said = state.get if state.exists else (None, [None] * len(STAGES), [None] * len(STAGES))
        times, said = list(times), list(said)
        for pdf in batches:
            for stage, status, us in zip(pdf["stage"], pdf["status"], pdf["us"], strict=True):
                i = STAGES.index(stage)
                new, old = (int(us), status or ""), (times[i], said[i] or "")
                if times[i] is None or new > old:
                    times[i], said[i] = int(us), status
                last = int(us) if last is None else max(last, int(us))
        state.update((last, times, said))
        until, mark = last // 1000 + quiet_ms, state.getCurrentWatermarkMs()
        silent = until < mark
        if not silent and until > 0:
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame({"run_id": [key[0]] * len(STAGES), "stage": list(STAGES), "status": statuses_of(said, silent)})

    kept = stage_events(events).withWatermark("ts", delay).select("run_id", "stage", "status", "ts", F.unix_micros("ts").alias("us"))
    schema = f"run_id {run_type}, stage string, status string"
    states = kept.groupBy("run_id").applyInPandasWithState(follow, schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    return spark.read.schema(f"{schema}, batch_id int").parquet(out).groupBy("run_id", "stage").agg(F.max_by("status", "batch_id").alias("status"))
