"""Run metrics as aggregations over event and run tables.

``run_events(run_id, ts, kind)`` holds one row per counted event with kind
``task``, ``prompt``, ``correction``, ``auto`` or ``human``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.stats import corr_sql

KINDS = {"prompts": "prompt", "tasks": "task", "corrections": "correction", "auto_mods": "auto", "human_mods": "human"}
STAGES = ("ingestion", "cleaning", "transformation", "feature_engineering", "eda", "split", "vectorization")


def _ratio(a: str, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.col(a) / b)


def run_counters(events: DataFrame) -> DataFrame:
    """Events per kind and run."""
    return events.groupBy("run_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in KINDS.items()])


def run_ratios(events: DataFrame, digits: int = 4) -> DataFrame:
    """``pdr`` = prompts/tasks, ``sas`` = auto/(auto+human), ``cof`` = corrections/tasks; 0 without a denominator."""
    c = _with_ratios(run_counters(events))
    return c.withColumns({n: F.round(n, digits) for n in ("pdr", "sas", "cof")})


def _with_ratios(counters: DataFrame) -> DataFrame:
    return counters.withColumns({
        "pdr": _ratio("prompts", F.col("tasks")), "sas": _ratio("auto_mods", F.col("auto_mods") + F.col("human_mods")),
        "cof": _ratio("corrections", F.col("tasks")),
    })


def run_autonomy(events: DataFrame, digits: int = 4) -> DataFrame:
    """Counters, ratios and ``ptma`` = sas / (1 + pdr + cof), rounded at the end."""
    c = _with_ratios(run_counters(events))
    c = c.withColumn("ptma", F.col("sas") / (1 + F.col("pdr") + F.col("cof")))
    return c.withColumns({n: F.round(n, digits) for n in ("pdr", "sas", "cof", "ptma")})


def run_interpretation(scores: DataFrame) -> DataFrame:
    """Words for the scores of ``run_autonomy``."""
    c = F.col
    return scores.select(
        "run_id", "pdr", "sas", "cof", "ptma",
        F.when(c("sas") > 0.7, "high").when(c("sas") > 0.3, "medium").otherwise("low").alias("autonomy_level"),
        F.when(c("pdr") < 0.2, "excellent").when(c("pdr") < 0.5, "good").otherwise("needs_improvement").alias("efficiency"),
        F.when(c("cof") < 0.1, "excellent").when(c("cof") < 0.3, "good").otherwise("needs_improvement").alias("accuracy"),
        F.when(c("ptma") > 0.8, "excellent").when(c("ptma") > 0.6, "good").when(c("ptma") > 0.4, "fair")
        .otherwise("needs_improvement").alias("ptma_band"),
    )


def rows_per_second(rows: str = "n_rows", seconds: str = "seconds") -> Column:
    return F.col(rows) / F.greatest(F.col(seconds), F.lit(0.1))


def run_summary(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Shape, gaps, time, speed and scores per run.

    ``runs(run_id, n_rows, n_columns, missing_values, seconds)``; one row per run
    on both sides. Runs without events score 0.
    """
    joined = runs.join(scores.select("run_id", "tasks", "pdr", "sas", "cof", "ptma"), "run_id", "left")
    joined = joined.na.fill(0, ["tasks", "pdr", "sas", "cof", "ptma"])
    cells = F.col("n_rows") * F.col("n_columns")
    completeness = F.when(cells > 0, F.round((cells - F.col("missing_values")) * 100.0 / cells, 2)).otherwise(F.lit(0.0))
    return joined.withColumns({
        "completeness_pct": completeness, "rows_per_second": rows_per_second(),
        "quality_score": F.round((1 - F.col("cof")) * 100, 9).cast("int"),
    })


def run_list(runs: DataFrame, scores: DataFrame, newest_first: bool = False) -> DataFrame:
    """(run_id, ts, seconds, ptma) in time order."""
    joined = runs.join(scores.select("run_id", "ptma"), "run_id", "left").na.fill(0, ["ptma"])
    order = [F.desc("ts") if newest_first else F.asc("ts"), F.asc("run_id")]
    return joined.select("run_id", "ts", "seconds", "ptma").orderBy(*order)


def benchmark_compare(results: DataFrame) -> DataFrame:
    """(metric, value): score range and spread, speed range, size/time correlation, effect of the assistant.

    ``results(dataset, n_rows, seconds, ptma, llm_enabled)``.
    """
    x = results.withColumn("rps", rows_per_second())
    on, off = F.when(F.col("llm_enabled"), F.col("ptma")), F.when(~F.col("llm_enabled"), F.col("ptma"))
    row = x.agg(
        F.count("*").cast("double").alias("runs"), F.min("ptma").alias("ptma_min"), F.max("ptma").alias("ptma_max"),
        F.stddev_pop("ptma").alias("ptma_std"), F.min("rps").alias("rps_min"), F.max("rps").alias("rps_max"),
        F.expr(corr_sql("cast(n_rows AS double)", "cast(seconds AS double)")).alias("rows_seconds_corr"),
        F.avg(on).alias("llm_on_mean"), F.stddev_pop(on).alias("llm_on_std"), F.avg(off).alias("llm_off_mean"), F.stddev_pop(off).alias("llm_off_std"),
    )
    both = F.col("llm_on_mean").isNotNull() & F.col("llm_off_mean").isNotNull()
    delta = F.when(~both, F.lit(None)).when(F.col("llm_off_mean") > 0, (F.col("llm_on_mean") - F.col("llm_off_mean")) / F.col("llm_off_mean") * 100).otherwise(F.lit(0.0))
    row = row.withColumn("llm_delta_pct", delta)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("r")).select("r.*")


def benchmark_table(results: DataFrame) -> DataFrame:
    """The results with their speed, one row per run."""
    return results.withColumn("rows_per_second", rows_per_second())


def stage_status(stage_events: DataFrame, silence: str | None = None, as_of: Column | None = None) -> DataFrame:
    """(run_id, stage, status): last status per stage; stages after the first failure count as pending.

    ``stage_events(run_id, stage, status, ts)``; every run lists all seven stages. With ``silence`` (an interval) a running
    stage has failed if the run's latest event is more than that before ``as_of``.
    """
    last = stage_events.where(F.col("stage").isin(*STAGES)).groupBy("run_id", "stage").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))
    per_run = last.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("m"), F.max("ts").alias("ts"))
    silent = F.coalesce(F.col("ts") + F.expr(f"interval {silence}") < as_of, F.lit(False)) if silence else F.lit(False)
    now = lambda s: F.when(silent & (F.col("m")[s] == "running"), "failed").otherwise(F.coalesce(F.col("m")[s], F.lit("pending")))
    per_run = per_run.withColumn("s", F.array(*[now(s) for s in STAGES])).withColumn("bad", F.array_position("s", "failed"))
    rows = F.array(*[
        F.struct(
            F.lit(s).alias("stage"),
            F.when((F.col("bad") > 0) & (F.lit(i + 1) > F.col("bad")), "pending").otherwise(F.col("s")[i]).alias("status"),
        )
        for i, s in enumerate(STAGES)
    ])
    return per_run.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")
