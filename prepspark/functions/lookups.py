"""Left lookups of a per-key table into a large table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, kinds

#: a lookup table is broadcast only up to this many rows and key bytes
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
#: keys treated as hot in the shuffled variant
HOT_KEYS = 1_000
HOT_BYTES = 1_000


def join_small(df: DataFrame, key: Column, table: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Left lookup by broadcast; the caller has measured ``table`` (key column ``__key``)."""
    return df.withColumn("__lk", key).join(F.broadcast(table), F.col("__lk") == F.col("__key"), "left").drop("__lk", "__key", *drop)


def join_large(df: DataFrame, key: Column, table: DataFrame, weight: str = "n") -> DataFrame:
    """Left lookup by shuffle. ``weight`` holds the rows per key.

    The hottest keys, which would each put all their rows into one task, are
    looked up from a bounded broadcast, and their rows are spread over random
    partitions for the shuffle. Null keys are spread the same way.
    """
    values = [c for c in table.columns if c not in ("__key", weight)]
    # hot keys are few and their rows short: the others stay in the shuffle
    hot = table.where(F.octet_length("__key") <= HOT_BYTES).orderBy(F.desc(weight), "__key").limit(HOT_KEYS)
    hot = hot.select(F.col("__key").alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    hashable = [col(c) for c, k in kinds(df).items() if k != "nested"]
    # the reading task's number separates equal rows too, and a repeated task gives the same value again
    spread = F.concat(F.lit("\x00hot"), F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), F.lit(4096)).cast("string"))
    out = df.withColumn("__lk", key).join(F.broadcast(hot), F.col("__lk") == F.col("__hot"), "left")
    out = out.withColumn("__cold", F.when(F.col("__hot").isNull() & F.col("__lk").isNotNull(), F.col("__lk")).otherwise(spread))
    out = out.join(table.drop(weight), F.col("__cold") == F.col("__key"), "left")
    picked = {c: F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(c)) for c in values}
    return out.withColumns(picked).drop("__key", "__lk", "__hot", "__cold", *[f"__hot_{c}" for c in values])


def lookup_join(df: DataFrame, table: DataFrame, key: Column, weight: str = "n", broadcast_rows: int | None = None) -> DataFrame:
    """Measure ``table`` (computed once, kept on the executors), then broadcast it or shuffle."""
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    # rows first; their whole size, keys and values, only where the rows are few
    small = table.count() <= limit
    if small:
        cells = F.octet_length(F.to_json(F.struct(*[col(c) for c in table.columns])))
        small = (table.agg(F.sum(cells.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    if not small:
        return join_large(df, key, table, weight)
    local = df.sparkSession.createDataFrame(table.collect(), table.schema)
    table.unpersist()
    return join_small(df, key, local, [weight])
