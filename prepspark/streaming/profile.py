"""Profiles that follow arriving files: a small state per file, merged on demand.

Every file is read once. Its state holds, per column, what counts, extremes, moments and text lengths need, a HyperLogLog sketch
of the different values and a KLL sketch of the numbers. States of any files merge into the profile of all of them, so fits that
rest on it follow new files without a look at old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, is_missing, kinds, num

_STATE = {
    "kind": "string", "n": "bigint", "missing": "bigint", "known": "bigint", "mean": "double", "m2": "double", "low": "double", "high": "double", "low_text": "string",
    "high_text": "string", "characters": "bigint", "distinct": "binary", "ranks": "binary",
}
STATE = "file string, `column` string, " + ", ".join(f"{k} {v}" for k, v in _STATE.items())


def profile_states(df: DataFrame, file: str | None = None) -> DataFrame:
    """One state per file (column ``file`` of ``df``, else one for the table) and column, from one aggregation."""
    ks = {c: k for c, k in kinds(df).items() if c != file and k != "nested"}
    aggs = []
    for i, (c, kind) in enumerate(ks.items()):
        known, x = ~is_missing(df, c), num(c) if kind == "numeric" else None
        text = col(c).cast("string")
        cells = {
            "n": F.count("*"), "missing": F.count_if(~known), "known": F.count_if(known),
            "mean": F.avg(x) if x is not None else None, "m2": F.var_pop(x) * F.count(x) if x is not None else None,
            "low": F.min(x) if x is not None else None, "high": F.max(x) if x is not None else None,
            "low_text": F.min(text) if x is None else None, "high_text": F.max(text) if x is None else None,
            "characters": F.sum(F.length(text)) if kind == "string" else None,
            "distinct": F.hll_sketch_agg(F.when(known, text)), "ranks": F.kll_sketch_agg_double(x) if x is not None else None,
        }
        fields = [F.lit(kind).alias("kind"), *[(F.lit(None) if v is None else v).cast(_STATE[k]).alias(k) for k, v in cells.items()]]
        aggs.append(F.struct(F.lit(c).alias("column"), *fields).alias(f"s{i}"))
    grouped = df.groupBy(col(file).alias("file")) if file else df.groupBy(F.lit("").alias("file"))
    return grouped.agg(*aggs).select("file", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(aggs))])).alias("s")).select("file", "s.*")


def merge_states(states: DataFrame) -> DataFrame:
    """(column, kind, n, missing, mean, stddev, low, high, low_text, high_text, mean_length, distinct, q25, median, q75) of all files together.

    All but ``distinct`` (HyperLogLog, about 2 %) and the quantiles (KLL, about 2 % of the ranks) are exact. Moments are merged about
    the common mean, so large means lose no digits.
    """
    means = states.groupBy("column").agg((F.sum(F.col("mean") * F.col("known")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("known")))).alias("all_mean"))
    off = F.col("mean") - F.col("all_mean")
    merged = states.join(means, "column").groupBy("column", "kind").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("known").alias("known"), F.max("all_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("known") * off * off).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_text").alias("low_text"),
        F.max("high_text").alias("high_text"), F.sum("characters").alias("characters"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))
    rank = lambda q: F.when((F.col("kind") == "numeric") & (F.col("known") > 0), F.kll_sketch_get_quantile_double("ranks", F.lit(q)))
    return merged.select(
        "column", "kind", "n", "missing", "mean", F.when(F.col("known") > 1, F.sqrt(F.col("m2") / (F.col("known") - 1))).alias("stddev"), "low", "high", "low_text", "high_text",
        F.when(F.col("known") > 0, F.col("characters") / F.col("known")).alias("mean_length"), F.hll_sketch_estimate("distinct").alias("distinct"),
        rank(0.25).alias("q25"), rank(0.5).alias("median"), rank(0.75).alias("q75"))


def stream_profile(stream: DataFrame, out: str, checkpoint: str, timeout_s: int | None = None) -> DataFrame:
    """Profile of all files that have arrived, the new ones read now and the others by their states below ``out``.

    Each batch writes its states to its own folder, so a replayed batch replaces them.
    """
    named = stream.withColumn("__file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        profile_states(batch, "__file").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    return merge_states(stream.sparkSession.read.schema(STATE).parquet(out))
