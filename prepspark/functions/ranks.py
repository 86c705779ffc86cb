"""Deterministic draws and exact-size cuts without sorting the table.

A row's draw position is the md5 of its key and a seed. To take exactly ``r``
rows, the hash value at rank ``r`` is found by counting rows per leading hex
digits and descending into the one cell that holds the rank. The cut itself is
then a plain comparison per row: no shuffle, no window, no hot class in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prepspark.functions.columns import col, kinds

#: cells one counting pass may return to the driver
MAX_CELLS = 65_536
#: rows of a cell whose hashes may be listed
LEAF_ROWS = 256
#: groups (classes) whose cuts are found on the driver; more are ranked as a table, with the same result
MAX_GROUPS = 10_000
#: upper bound of every md5 hex string
TOP = "g"
NULL_GROUP = "\x00null"


def key_hash(keys: list[str], seed: int = 42) -> Column:
    """md5 of the key columns and the seed, as 32 hex digits."""
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def group_text(group: str | Column | None) -> Column:
    if group is None:
        return F.lit("")
    c = col(group) if isinstance(group, str) else group
    return F.coalesce(c.cast("string"), F.lit(NULL_GROUP))


def group_sizes(df: DataFrame, group: str, limit: int | None = None) -> dict[str, int] | None:
    """Rows per class, as text; None where there are too many classes for the driver."""
    limit = MAX_GROUPS if limit is None else limit
    rows = size_table(df, group).limit(limit + 1).collect()
    return {r["g"]: r["n"] for r in rows} if len(rows) <= limit else None


def size_table(df: DataFrame, group: str) -> DataFrame:
    """(g, n): rows per class, as text."""
    return df.groupBy(group_text(group).alias("g")).agg(F.count("*").alias("n"))


def hash_cuts(
    df: DataFrame, h: Column, ranks: dict[str, list[int]], sizes: dict[str, int], group: str | Column | None = None,
) -> dict[str, list[str]]:
    """For every group and rank r, the hash T with exactly r rows below it."""
    # a cut needs the value at rank r and, to prove it splits no ties, the one before it
    open_: dict[tuple[str, int], tuple[str, int]] = {}
    cuts: dict[tuple[str, int], str] = {}
    for g, rs in ranks.items():
        for r in rs:
            if r <= 0:
                cuts[(g, r)] = ""
            elif r >= sizes.get(g, 0):
                cuts[(g, r)] = TOP
            else:
                open_[(g, r)] = ("", 0)
    keyed = df.select(group_text(group).alias("g"), h.alias("h"))
    depth = 0
    leaf_at = {k: sizes[k[0]] for k in open_}
    while open_ and any(leaf_at[k] > LEAF_ROWS for k in open_) and depth < 32:
        branches = {(g, p) for (g, _), (p, _) in open_.items()}
        digits = 3
        while digits > 1 and len(branches) * 16**digits > MAX_CELLS:
            digits -= 1
        digits = min(digits, 32 - depth)
        wanted = sorted({g + "\x01" + p for g, p in branches})
        inside = keyed.where(F.concat(F.col("g"), F.lit("\x01"), F.substring("h", 1, depth)).isin(wanted))
        cells: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for row in inside.groupBy("g", F.substring("h", 1, depth + digits).alias("p")).count().collect():
            cells.setdefault((row["g"], row["p"][:depth]), []).append((row["p"], row["count"]))
        for k, (prefix, below) in list(open_.items()):
            for p, n in sorted(cells[(k[0], prefix)]):
                if k[1] < below + n:
                    open_[k] = (p, below)
                    leaf_at[k] = n
                    break
                below += n
        depth += digits
    if open_:
        wanted = sorted({g + "\x01" + p for (g, _), (p, _) in open_.items()})
        cell = F.concat(F.col("g"), F.lit("\x01"), F.substring("h", 1, depth))
        leaves = keyed.where(cell.isin(wanted)).groupBy(cell.alias("c"))
        if depth >= 32:
            listed = {r["c"]: [(r["c"].split("\x01")[1], r["n"])] for r in leaves.agg(F.count("*").alias("n")).collect()}
        else:
            listed = {}
            for r in leaves.agg(F.sort_array(F.collect_list("h")).alias("hs")).collect():
                listed[r["c"]] = [(x, 1) for x in r["hs"]]
        for (g, r), (p, below) in open_.items():
            values = [x for x, n in listed[g + "\x01" + p] for _ in range(min(n, 2))]
            i = r - below
            if depth >= 32 and i > 0 or (i > 0 and values[i] == values[i - 1]):
                raise ValueError("the key columns are not unique at a cut: pass a unique key")
            cuts[(g, r)] = values[0] if depth >= 32 else values[i]
    return {g: [cuts[(g, r)] for r in rs] for g, rs in ranks.items()}


def below_cuts(df: DataFrame, h: Column, cuts: dict[str, list[str]], group: str | None = None) -> tuple[DataFrame, Column]:
    """Number of its group's cuts a row's hash has reached (0 before the first)."""
    def reached(thresholds: list[str]) -> Column:
        out = F.lit(0)
        for t in thresholds:
            out = out + (h >= F.lit(t)).cast("int")
        return out

    if group is None:
        return df, reached(cuts[""])
    if len(cuts) <= 64:
        g, expr = group_text(group), None
        for name, ts in sorted(cuts.items()):
            expr = F.when(g == name, reached(ts)) if expr is None else expr.when(g == name, reached(ts))
        return df, expr
    # group count is bounded by MAX_GROUPS, so this table is small by construction
    table = df.sparkSession.createDataFrame(
        list(cuts.items()), T.StructType([T.StructField("__g", T.StringType()), T.StructField("__cuts", T.ArrayType(T.StringType()))])
    )
    joined = df.join(F.broadcast(table), group_text(group) == F.col("__g"), "left")
    return joined, F.size(F.filter("__cuts", lambda t: h >= t))


def rank_in_group(df: DataFrame, h: Column, group: str | None, name: str = "rank") -> DataFrame:
    """0-based rank by hash inside each group, without one window per group; equal hashes rank by a digest of the row.

    Rows are cut into (group, leading digits) buckets, so even a group holding most rows is spread evenly; bucket
    offsets are prefix sums over the few buckets of a group, and are broadcast only where there are few of them.
    """
    keyed = df.withColumns({"__h": h, "__g": group_text(group)})
    n_groups = keyed.select("__g").distinct().count() if group else 1
    digits = 4
    while digits > 1 and n_groups * 16**digits > MAX_CELLS:
        digits -= 1
    keyed = keyed.withColumn("__b", F.substring("__h", 1, digits))
    counted = keyed.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = counted.select("__g", "__b", offset.alias("__off"))
    hashable = [col(c) for c, k in kinds(df).items() if k != "nested"]
    w = Window.partitionBy("__g", "__b").orderBy("__h", F.xxhash64(*hashable))
    ranked = keyed.withColumn("__rn", F.row_number().over(w))
    ranked = ranked.join(F.broadcast(table) if n_groups * 16**digits <= MAX_CELLS else table, ["__g", "__b"])
    return ranked.withColumn(name, F.col("__rn") - 1 + F.col("__off")).drop("__h", "__g", "__b", "__rn", "__off")


def rank_values(values: DataFrame, name: str, out: str = "idx", target_rows: int = 100_000, with_bucket: bool = False) -> DataFrame:
    """0-based rank of distinct values in their natural order.

    Boundaries come from a hash-chosen subset of the values, which is the same on
    every run; each interval is numbered on its own and shifted by the number of
    values before it. Boundary choice affects balance only, never the result.
    """
    n = values.count()
    parts = max(1, min(8, n // 10), min(2000, n // target_rows))
    bounds: list = []
    if parts > 1:
        keep = max(1, n // (parts * 20))
        picked = values.where(F.pmod(F.xxhash64(col(name)), F.lit(keep)) == 0).select(name).collect()
        ordered = sorted(r[0] for r in picked)
        bounds = sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if ordered else []
    bucket = F.size(F.filter(F.lit(bounds), lambda b: b <= col(name))) if bounds else F.lit(0)
    placed = values.withColumn("__b", bucket)
    counts = dict(sorted((r["__b"], r["count"]) for r in placed.groupBy("__b").count().collect()))
    starts, run = [], 0
    for b in range(len(bounds) + 1):
        starts.append(run)
        run += counts.get(b, 0)
    w = Window.partitionBy("__b").orderBy(col(name))
    offset = F.element_at(F.lit(starts), F.col("__b") + 1)
    return placed.withColumn(out, (F.row_number().over(w) - 1 + offset).cast("long")).drop(*[] if with_bucket else ["__b"])
