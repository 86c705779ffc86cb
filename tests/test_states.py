"""Run states that follow a stream of stage events."""

import datetime as dt

from prepspark.operators import runs
from prepspark.session import scratch_path
from prepspark.streaming import ingest, states

SCHEMA = "run_id string, stage string, status string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def rows_of(events):
    return [(r, s, t, None if m is None else START + dt.timedelta(minutes=m)) for r, s, t, m in events]


def drain(spark, batches):
    """States after the batches, a file each, read one file at a time."""
    folder = scratch_path(spark, "stage-events")
    for b in batches:
        spark.createDataFrame(rows_of(b), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger="1")
    out = states.stream_run_states(stream, scratch_path(spark, "states"), scratch_path(spark, "ckpt"), "30 minutes", "10 minutes")
    got = {}
    for r in out.collect():
        got.setdefault(r.run_id, {})[r.stage] = r.status
    return got


def test_silence_failure_order_and_revival(spark):
    first = [
        ("quiet", "ingestion", "completed", 0), ("quiet", "cleaning", "running", 1), ("back", "ingestion", "running", 2),
        ("bad", "cleaning", "failed", 3), ("bad", "split", "completed", 4), ("bad", "ingestion", "completed", 5), ("done", "ingestion", "completed", 0),
        (None, "ingestion", "running", 3), ("odd", "nothing", "running", 3), ("late", "eda", "running", None), ("live", "cleaning", None, 2),
    ]
    second = [("live", "ingestion", "completed", 118), ("live", "ingestion", "running", 117), ("live", "ingestion", "running", 110)]
    third = [("back", "ingestion", "completed", 119), ("live", "cleaning", "running", 120), ("live", "cleaning", "running", 120)]
    got = drain(spark, [first, second, third])
    assert set(got) == {"quiet", "back", "bad", "done", "live"}
    assert got["quiet"] == {s: {"ingestion": "completed", "cleaning": "failed"}.get(s, "pending") for s in runs.STAGES}
    assert got["back"]["ingestion"] == "completed"
    assert (got["bad"]["ingestion"], got["bad"]["cleaning"], got["bad"]["split"]) == ("completed", "failed", "pending")
    assert (got["live"]["ingestion"], got["live"]["cleaning"], got["live"]["eda"]) == ("completed", "running", "pending")
    assert drain(spark, [first + second + third]) == got
    kept = states.stage_events(spark.createDataFrame(rows_of(first + second + third), SCHEMA))
    as_of = START + dt.timedelta(minutes=110)
    batch = runs.stage_status(kept, "30 minutes", states.F.lit(as_of)).collect()
    assert {(r.run_id, r.stage, r.status) for r in batch} == {(r, s, t) for r, m in got.items() for s, t in m.items()}
    assert drain(spark, [[]]) == {}
