"""Run-metric queries over run events derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import load, query, round_doubles
from prepspark.operators import clean, runs
from prepspark.sources import history
from prepspark.session import scratch_path
from prepspark.streaming import ingest, metrics, states
from prepspark.streaming import profile as stream_profiles

# Which event type stands for which kind of run event.
_KIND_OF = {"click": "task", "view": "auto", "purchase": "prompt", "signup": "human", "error": "correction"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in _KIND_OF.items()) + " END"
_EVENTS = f"e AS (SELECT user_id AS run_id, ts, {_KIND_SQL} AS kind FROM events)"
_COUNTS = _EVENTS + """, k AS (SELECT run_id, (count(*) FILTER (kind = 'prompt'))::BIGINT AS prompts, (count(*) FILTER (kind = 'task'))::BIGINT AS tasks,
  (count(*) FILTER (kind = 'correction'))::BIGINT AS corrections, (count(*) FILTER (kind = 'auto'))::BIGINT AS auto_mods,
  (count(*) FILTER (kind = 'human'))::BIGINT AS human_mods FROM e GROUP BY 1)"""
_RATIOS = _COUNTS + """, q AS (SELECT *, CASE WHEN tasks = 0 THEN 0 ELSE prompts / tasks::DOUBLE END AS pdr,
  CASE WHEN auto_mods + human_mods = 0 THEN 0 ELSE auto_mods / (auto_mods + human_mods)::DOUBLE END AS sas,
  CASE WHEN tasks = 0 THEN 0 ELSE corrections / tasks::DOUBLE END AS cof FROM k)"""
_SCORES = _RATIOS + """, s AS (SELECT run_id, prompts, tasks, corrections, auto_mods, human_mods, round(pdr, 4) AS pdr, round(sas, 4) AS sas, round(cof, 4) AS cof,
  round(sas / (1 + pdr + cof), 4) AS ptma FROM q)"""
_RUNS = """, r AS (SELECT user_id AS run_id, max(ts) AS ts, count(*)::BIGINT AS n_rows, 6 AS n_columns, (count(*) FILTER (value < 2))::BIGINT AS missing_values,
  round(sum(value) / 10, 4) AS seconds FROM events GROUP BY 1)"""


def run_events(e):
    kind = None
    for t, k in _KIND_OF.items():
        kind = F.when(F.col("event_type") == t, k) if kind is None else kind.when(F.col("event_type") == t, k)
    return e.select(F.col("user_id").alias("run_id"), "ts", kind.alias("kind"))


def run_table(e):
    return e.groupBy(F.col("user_id").alias("run_id")).agg(
        F.max("ts").alias("ts"), F.count("*").alias("n_rows"), F.max(F.lit(6)).alias("n_columns"), F.count_if(F.col("value") < 2).alias("missing_values"),
        F.round(F.sum("value") / 10, 4).alias("seconds"),
    )


@query("run_counters", f"WITH {_COUNTS} SELECT * FROM k")
def run_counters(spark, d):
    return runs.run_counters(run_events(load(spark, d, "events")))


@query("run_ratios", f"WITH {_RATIOS} SELECT * REPLACE (round(pdr, 4) AS pdr, round(sas, 4) AS sas, round(cof, 4) AS cof) FROM q")
def run_ratios(spark, d):
    return runs.run_ratios(run_events(load(spark, d, "events")))


@query("run_autonomy", f"WITH {_SCORES} SELECT * FROM s")
def run_autonomy(spark, d):
    return runs.run_autonomy(run_events(load(spark, d, "events")))


@query("run_interpretation", f"""WITH {_SCORES} SELECT run_id, pdr, sas, cof, ptma, CASE WHEN sas > 0.7 THEN 'high' WHEN sas > 0.3 THEN 'medium' ELSE 'low' END AS autonomy_level,
  CASE WHEN pdr < 0.2 THEN 'excellent' WHEN pdr < 0.5 THEN 'good' ELSE 'needs_improvement' END AS efficiency,
  CASE WHEN cof < 0.1 THEN 'excellent' WHEN cof < 0.3 THEN 'good' ELSE 'needs_improvement' END AS accuracy,
  CASE WHEN ptma > 0.8 THEN 'excellent' WHEN ptma > 0.6 THEN 'good' WHEN ptma > 0.4 THEN 'fair' ELSE 'needs_improvement' END AS ptma_band FROM s""")
def run_interpretation(spark, d):
    return runs.run_interpretation(runs.run_autonomy(run_events(load(spark, d, "events"))))


@query("run_summary", f"""WITH {_SCORES}{_RUNS} SELECT r.*, tasks, pdr, sas, cof, ptma, round((n_rows * n_columns - missing_values) * 100.0::DOUBLE / (n_rows * n_columns), 2) AS completeness_pct,
  round(n_rows / greatest(0.1, seconds), 6) AS rows_per_second, trunc(round((1 - cof) * 100, 9))::INTEGER AS quality_score FROM r JOIN s USING (run_id)""")
def run_summary(spark, d):
    e = load(spark, d, "events")
    return round_doubles(runs.run_summary(run_table(e), runs.run_autonomy(run_events(e))))


@query("run_list", f"WITH {_SCORES}{_RUNS} SELECT run_id, ts, seconds, ptma FROM r JOIN s USING (run_id) ORDER BY ts, run_id")
def run_list(spark, d):
    e = load(spark, d, "events")
    return runs.run_list(run_table(e), runs.run_autonomy(run_events(e)))


_RESULTS = _SCORES + _RUNS + ", x AS (SELECT run_id AS dataset, n_rows, seconds, ptma, run_id % 2 = 0 AS llm_enabled, n_rows / greatest(0.1, seconds) AS rps FROM r JOIN s USING (run_id))"


@query("benchmark_compare", f"""WITH {_RESULTS}, a AS (SELECT count(*)::DOUBLE AS runs, min(ptma) AS ptma_min, max(ptma) AS ptma_max, stddev_pop(ptma) AS ptma_std, min(rps) AS rps_min, max(rps) AS rps_max,
  corr(n_rows, seconds) AS rows_seconds_corr, avg(ptma) FILTER (llm_enabled) AS llm_on_mean, stddev_pop(ptma) FILTER (llm_enabled) AS llm_on_std,
  avg(ptma) FILTER (NOT llm_enabled) AS llm_off_mean, stddev_pop(ptma) FILTER (NOT llm_enabled) AS llm_off_std FROM x),
b AS (SELECT *, (llm_on_mean - llm_off_mean) / llm_off_mean * 100 AS llm_delta_pct FROM a)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value)""")
def benchmark_compare(spark, d):
    return round_doubles(runs.benchmark_compare(_results(spark, d)))


def _results(spark, d):
    e = load(spark, d, "events")
    joined = run_table(e).join(runs.run_autonomy(run_events(e)).select("run_id", "ptma"), "run_id")
    return joined.select(F.col("run_id").alias("dataset"), "n_rows", "seconds", "ptma", (F.col("run_id") % 2 == 0).alias("llm_enabled"))


@query("benchmark_table", f"WITH {_RESULTS} SELECT dataset, n_rows, seconds, ptma, llm_enabled, round(rps, 6) AS rows_per_second FROM x")
def benchmark_table(spark, d):
    return round_doubles(runs.benchmark_table(_results(spark, d)))


_STAGE_LIST = ", ".join(f"'{s}'" for s in runs.STAGES)


@query("stage_status", f"""WITH g AS (SELECT user_id AS run_id, (event_id % 7)::INTEGER AS i, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END, ts) AS status FROM events GROUP BY 1, 2),
a AS (SELECT DISTINCT user_id AS run_id, i FROM events, (SELECT unnest(range(0, 7))::INTEGER AS i)),
f AS (SELECT run_id, min(i) FILTER (status = 'failed') AS bad FROM g GROUP BY 1)
SELECT a.run_id, [{_STAGE_LIST}][a.i + 1] AS stage, CASE WHEN a.i > bad THEN 'pending' ELSE coalesce(status, 'pending') END AS status
FROM a LEFT JOIN g ON g.run_id = a.run_id AND g.i = a.i LEFT JOIN f ON f.run_id = a.run_id""")
def stage_status(spark, d):
    e = load(spark, d, "events")
    stage = F.element_at(F.array(*[F.lit(s) for s in runs.STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    return runs.stage_status(e.select(F.col("user_id").alias("run_id"), stage.alias("stage"), status.alias("status"), "ts"))


def _states_sql(as_of: str) -> str:
    """Statuses with silence: running stages of runs without an event in the six hours before ``as_of`` have failed."""
    return f"""WITH g AS (SELECT user_id AS run_id, (event_id % 7)::INTEGER AS i, arg_max({_RUN_STATUS}, ts) AS status FROM events GROUP BY 1, 2),
l AS (SELECT user_id AS run_id, max(ts) + INTERVAL 6 HOUR < (SELECT {as_of} FROM events) AS silent FROM events GROUP BY 1),
a AS (SELECT run_id, i, silent FROM l, (SELECT unnest(range(0, 7))::INTEGER AS i)),
h AS (SELECT a.run_id, a.i, CASE WHEN silent AND status = 'running' THEN 'failed' ELSE coalesce(status, 'pending') END AS status FROM a LEFT JOIN g USING (run_id, i)),
f AS (SELECT run_id, min(i) FILTER (status = 'failed') AS bad FROM h GROUP BY 1)
SELECT run_id, [{_STAGE_LIST}][i + 1] AS stage, CASE WHEN i > bad THEN 'pending' ELSE status END AS status FROM h JOIN f USING (run_id)"""


_RUN_STATUS = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 3 = 0 THEN 'running' ELSE 'completed' END"


def _run_stages(e):
    stage = F.element_at(F.array(*[F.lit(s) for s in runs.STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.col("user_id").alias("run_id"), stage.alias("stage"), F.expr(_RUN_STATUS).alias("status"), F.col("ts").cast("timestamp").alias("ts"))


@query("stage_status_silence", _states_sql("max(ts) - INTERVAL 1 DAY"))
def stage_status_silence(spark, d):
    e = _run_stages(load(spark, d, "events"))
    return runs.stage_status(e, "6 hours", F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("interval 1 day"))


@query("stream_run_states", f"SELECT files, s.* FROM ({_states_sql("date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY")}) s, (SELECT unnest(['1', '100']) AS files)")
def stream_run_states(spark, d):
    """Four files whose events lie up to a day out of order: one file a batch and all at once give the same states."""
    e = load(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))
    low, high = e.agg(F.min(at), F.max(at)).first()
    folder = scratch_path(spark, "stage-events")
    for i in range(4):
        e.where(F.least(F.floor((at - low) * 4 / (high - low)), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(folder)
    out = None
    for n in ("1", "100"):
        stream = _run_stages(ingest.file_stream(spark, folder, e.schema, maxFilesPerTrigger=n))
        one = states.stream_run_states(stream, scratch_path(spark, "states"), scratch_path(spark, "ckpt"), "6 hours", "1 day").withColumn("files", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("run_history_topn", f"WITH {_SCORES}{_RUNS} SELECT run_id, ts, seconds, ptma FROM r JOIN s USING (run_id) ORDER BY ts DESC, run_id DESC LIMIT 5")
def run_history_topn(spark, d):
    """Two appends to the history table, then the last five runs."""
    e = load(spark, d, "events")
    listed = runs.run_list(run_table(e), runs.run_autonomy(run_events(e)))
    path = scratch_path(spark, "history")
    history.append_run(listed.where("run_id % 2 = 0"), path)
    history.append_run(listed.where("run_id % 2 = 1"), path)
    return history.run_history_topn(history.run_history(spark, path))


@query("stream_run_metrics", f"WITH {_EVENTS} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, run_id, kind, count(*)::BIGINT AS n FROM e GROUP BY 1, 2, 3")
def stream_run_metrics(spark, d):
    schema = load(spark, d, "events").schema
    stream = ingest.file_stream(spark, d, schema, pathGlobFilter="events.parquet")
    live = run_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    out = metrics.stream_run_metrics(live, scratch_path(spark, "live"), scratch_path(spark, "ckpt"), "1 day", "1 day")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_file_ingest", """WITH g AS (SELECT event_id, ts, CASE WHEN event_id % 7 <> 3 THEN user_id::DOUBLE END AS user_id, event_type, CASE WHEN event_id % 5 <> 1 THEN value END AS value FROM events),
r AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE event_id % 10 = 0), m AS (SELECT avg(user_id) AS u, avg(value) AS v FROM r)
SELECT files, event_id, ts, round(coalesce(user_id, u), 6) AS user_id, event_type, round(coalesce(value, v), 6) AS value FROM g, m, (SELECT unnest(['1', '100']) AS files)""")
def stream_file_ingest(spark, d):
    """Events with gaps and repeats over several files: one file a batch and all at once give the same table."""
    e = load(spark, d, "events")
    g = e.select("event_id", "ts", F.when(F.col("event_id") % 7 != 3, F.col("user_id")).alias("user_id"), "event_type", F.when(F.col("event_id") % 5 != 1, F.col("value")).alias("value"))
    again = g.where("event_id % 10 = 0")
    folder = scratch_path(spark, "arrivals")
    g.repartition(3).write.parquet(folder)
    again.repartition(2).write.mode("append").parquet(folder)
    arrived = spark.read.parquet(folder)
    fit, out = clean.fit_cleaning(arrived), None
    for n in ("1", "100"):
        stream = ingest.file_stream(spark, folder, arrived.schema, maxFilesPerTrigger=n)
        one = ingest.stream_file_ingest(stream, scratch_path(spark, "ingest"), scratch_path(spark, "ckpt"), fit, ["event_id"], "ts", "3650 days")
        one = one.select("event_id", "ts", "user_id", "event_type", "value").withColumn("files", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return round_doubles(out)


_PROFILED = ["event_id", "user_id", "value"]


@query("stream_profile", "WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 1 THEN value END AS value, event_type FROM events) " + " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", count(*)::BIGINT AS n, (count(*) - count({c}))::BIGINT AS missing, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 5) AS stddev,
  min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, NULL::VARCHAR AS low_text, NULL::DOUBLE AS mean_length, true AS distinct_close, true AS median_close FROM g""" for c in _PROFILED]
    + ["SELECT 'event_type', count(*), count(*) - count(event_type), NULL, NULL, NULL, NULL, min(event_type), round(avg(length(event_type)), 9), true, NULL FROM g"]))
def stream_profile(spark, d):
    """Five files arrive in two goes; the second go reads the new ones only. Exact parts as they are, sketches against exact values."""
    e = load(spark, d, "events")
    g = e.select("event_id", "user_id", F.when(F.col("event_id") % 5 != 1, F.col("value")).alias("value"), "event_type")
    folder, out, mark = (scratch_path(spark, n) for n in ("arrivals", "states", "ckpt"))
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        g.where(part).repartition(2).write.mode("append").parquet(folder)
        found = stream_profiles.stream_profile(ingest.file_stream(spark, folder, g.schema, maxFilesPerTrigger="1"), out, mark)
    exact = g.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in g.columns]).first()
    medians = {r["column"]: r["median"] for r in found.select("column", "median").collect()}
    below = g.agg(*[(F.count_if(F.col(c) <= medians[c]) / F.count(c)).alias(c) for c in _PROFILED]).first()
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("column"))
    near = F.abs(F.col("distinct") - pick({c: exact[f"d_{c}"] for c in g.columns})) <= 0.06 * pick({c: exact[f"d_{c}"] for c in g.columns})
    middle = F.when(F.col("kind") == "numeric", F.abs(F.try_element_at(F.create_map(*[F.lit(x) for c in _PROFILED for x in (c, below[c])]), F.col("column")) - 0.5) <= 0.03)
    # Means of values with two digits end within nine, so none lies between two roundings.
    found = found.withColumn("stddev", F.round("stddev", 5))
    return round_doubles(found.select("column", "n", "missing", "mean", "stddev", "low", "high", "low_text", "mean_length", near.alias("distinct_close"), middle.alias("median_close")), 9)
