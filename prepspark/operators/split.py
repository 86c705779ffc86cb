"""Train/test splits and folds of exact size, reproducible from a key and a seed."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prepspark.functions.columns import col, kinds, one_row
from prepspark.functions.lookups import lookup_join
from prepspark.functions.ranks import (
    below_cuts, group_sizes, group_text, hash_cuts, key_hash, rank_in_group, rank_values, size_table,
)
from prepspark.functions.stats import select_ranks

def part_sizes(n: int, share: float) -> tuple[int, int]:
    """(train, test) rows: the test side is rounded up."""
    n_test = math.ceil(n * share)
    if n and (n_test >= n or n_test <= 0):
        raise ValueError(f"a share of {share} leaves one side of {n} rows empty")
    return n - n_test, n_test


def split_random(
    df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42, stratify: str | None = None,
    names: tuple[str, str] = ("train", "test"), out: str = "part",
) -> DataFrame:
    """Mark exactly ceil(n * test_size) rows as test: the lowest key hashes."""
    if stratify is not None:
        return split_stratified(df, keys, stratify, test_size, seed, names, out)
    n = df.count()
    _, n_test = part_sizes(n, test_size)
    h = key_hash(keys, seed)
    cut = hash_cuts(df, h, {"": [n_test]}, {"": n})[""][0]
    return df.withColumn(out, F.when(h < F.lit(cut), names[1]).otherwise(names[0]))


def class_quota(sizes: dict[str, int], wanted: int) -> dict[str, int]:
    """Rows to take per class: proportional, the remainder to the largest fractions, then by class."""
    n = sum(sizes.values())
    base = {g: wanted * s // n for g, s in sizes.items()}
    left = wanted - sum(base.values())
    order = sorted(sizes, key=lambda g: (-((wanted * sizes[g]) % n), g))
    return {g: base[g] + (1 if g in order[:left] else 0) for g in sizes}


def split_stratified(
    df: DataFrame, keys: list[str], target: str, test_size: float = 0.2, seed: int = 42,
    names: tuple[str, str] = ("train", "test"), out: str = "part", max_classes: int | None = None,
) -> DataFrame:
    """As ``split_random`` with the same share of every class on both sides.

    Beyond ``max_classes`` class sizes and quotas stay a table; the result is the same.
    """
    sizes = group_sizes(df, target, max_classes)
    if sizes is None:
        return _split_many(df, keys, target, test_size, seed, names, out)
    n_train, n_test = part_sizes(sum(sizes.values()), test_size)
    if min(sizes.values()) < 2:
        raise ValueError("the least populated class has only one row")
    if min(n_train, n_test) < len(sizes):
        raise ValueError(f"{len(sizes)} classes do not fit into {min(n_train, n_test)} rows")
    quota = class_quota(sizes, n_test)
    h = key_hash(keys, seed)
    cuts = hash_cuts(df, h, {g: [q] for g, q in quota.items()}, sizes, target)
    source, reached = below_cuts(df, h, cuts, target)
    return source.withColumn(out, F.when(reached == 0, names[1]).otherwise(names[0])).select(*[col(c) for c in df.columns], out)


def _split_many(df: DataFrame, keys: list[str], target: str, share: float, seed: int, names: tuple[str, str], out: str) -> DataFrame:
    """``split_stratified`` for any number of classes: quotas per class size, ranks inside classes."""
    table = size_table(df, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # classes of one size share quota and remainder; there are few different sizes
        sizes = {r["n"]: r["k"] for r in table.groupBy("n").agg(F.count("*").alias("k")).collect()}
        n_train, n_test = part_sizes(sum(s * k for s, k in sizes.items()), share)
        if min(sizes) < 2:
            raise ValueError("the least populated class has only one row")
        if min(n_train, n_test) < sum(sizes.values()):
            raise ValueError(f"{sum(sizes.values())} classes do not fit into {min(n_train, n_test)} rows")
        n = n_train + n_test
        left = n_test - sum(k * (n_test * s // n) for s, k in sizes.items())
        more, even = [], None
        # classes with equal remainders take the odd rows by name, whatever their size
        rest: dict[int, list[int]] = {}
        for s in sizes:
            rest.setdefault((n_test * s) % n, []).append(s)
        for r in sorted(rest, reverse=True):
            k = sum(sizes[s] for s in rest[r])
            if k <= left:
                more += rest[r]
                left -= k
            else:
                even = (rest[r], left)
                break
        quota = F.expr(f"{n_test} * CAST(n AS DECIMAL(38,0)) div {n}") + F.col("n").isin(more).cast("int")
        quotas = table.withColumn("quota", quota)
        if even and even[1]:
            some = rank_values(table.where(F.col("n").isin(even[0])).select("g"), "g", "place").where(F.col("place") < even[1]).select("g", F.lit(1).alias("odd"))
            quotas = quotas.join(some, "g", "left").withColumn("quota", F.col("quota") + F.coalesce("odd", F.lit(0)))
        ranked = rank_in_group(df, key_hash(keys, seed), target, "__rank")
        lookup = quotas.select(F.col("g").alias("__key"), "n", F.col("quota").alias("__quota"))
        joined = lookup_join(ranked, lookup, group_text(target))
        return joined.withColumn(out, F.when(F.col("__rank") < F.col("__quota"), names[1]).otherwise(names[0])).select(*[col(c) for c in df.columns], out)
    finally:
        table.unpersist()


def holdout(df: DataFrame, keys: list[str], holdout_size: float = 0.1, seed: int = 42) -> DataFrame:
    return split_random(df, keys, holdout_size, seed, names=("train", "holdout"))


def timeseries_bounds(n: int, n_splits: int) -> list[int]:
    """First test row of each split; a split's test rows end where the next one's begin."""
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{n_splits} splits need more than {n} rows")
    return [n - n_splits * size + i * size for i in range(n_splits)]


def _order_value(df: DataFrame, name: str) -> Column:
    kind, dtype = kinds(df)[name], dict(df.dtypes)[name]
    if kind == "datetime":
        return F.unix_micros(col(name).cast("timestamp"))
    if kind == "numeric":
        return col(name) if dtype in ("bigint", "int", "smallint", "tinyint") else col(name).cast("double")
    raise ValueError(f"order column '{name}' must be numeric or temporal")


def split_timeseries(df: DataFrame, order_by: str, keys: list[str], n_splits: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """``fold`` 0 for rows that only train; fold i is the test set of split i, trained on all lower folds.

    Rows are ordered by ``order_by``, equal values by key hash. The few values at
    the fold borders are found by counting; no row is sorted.
    """
    n = df.count()
    bounds = timeseries_bounds(n, n_splits)
    x, h = _order_value(df, order_by), key_hash(keys, seed)
    sizes = one_row(df, {"x": F.count(x)})
    if sizes["x"] != n:
        raise ValueError(f"order column '{order_by}' has missing values")
    at = select_ranks(df, {"x": (x, bounds)}, sizes)["x"]
    values = sorted(set(at.values()))
    counts = one_row(df, {
        **{("lt", v): F.count_if(x < F.lit(v)) for v in values}, **{("eq", v): F.count_if(x == F.lit(v)) for v in values},
    })
    inner: dict[str, list[int]] = {}
    for r in bounds:
        v = at[r]
        inner.setdefault(str(values.index(v)), []).append(r - counts[("lt", v)])
    tie = None
    for i, v in enumerate(values):
        tie = F.when(x == F.lit(v), F.lit(str(i))) if tie is None else tie.when(x == F.lit(v), F.lit(str(i)))
    eq = {str(i): counts[("eq", v)] for i, v in enumerate(values)}
    cuts = hash_cuts(df.where(x.isin(values)), h, inner, eq, tie)
    fold = F.lit(0)
    for g, ts in cuts.items():
        v = values[int(g)]
        for t in ts:
            fold = fold + ((x > F.lit(v)) | ((x == F.lit(v)) & (h >= F.lit(t)))).cast("int")
    return df.withColumn(out, fold)


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def _starts(sizes: list[int]) -> list[int]:
    out, run = [], 0
    for s in sizes[:-1]:
        run += s
        out.append(run)
    return out


def kfold(df: DataFrame, keys: list[str], n_splits: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 0..k-1 in hash order; the first n mod k folds hold one row more."""
    n = df.count()
    if n_splits > n:
        raise ValueError(f"{n_splits} folds need more than {n} rows")
    h = key_hash(keys, seed)
    cuts = hash_cuts(df, h, {"": _starts(fold_sizes(n, n_splits))}, {"": n})
    source, fold = below_cuts(df, h, cuts)
    return source.withColumn(out, fold)


def kfold_stratified(
    df: DataFrame, keys: list[str], target: str, n_splits: int = 5, seed: int = 42, out: str = "fold", max_classes: int | None = None,
) -> DataFrame:
    """As ``kfold`` inside every class, the odd rows of successive classes going to successive folds.

    Beyond ``max_classes`` sizes and turns stay a table; the result is the same.
    """
    sizes = group_sizes(df, target, max_classes)
    h = key_hash(keys, seed)
    if sizes is None:
        return _folds_many(df, h, target, n_splits, out)
    if n_splits > max(sizes.values()):
        raise ValueError(f"{n_splits} folds need more than {max(sizes.values())} rows in a class")
    ranks, turn = {}, 0
    for g in sorted(sizes):
        extra = {(turn + i) % n_splits for i in range(sizes[g] % n_splits)}
        ranks[g] = _starts([sizes[g] // n_splits + (1 if i in extra else 0) for i in range(n_splits)])
        turn = (turn + sizes[g]) % n_splits
    cuts = hash_cuts(df, h, ranks, sizes, target)
    source, fold = below_cuts(df, h, cuts, target)
    return source.withColumn(out, fold.cast("int")).select(*[col(c) for c in df.columns], out)


def _folds_many(df: DataFrame, h: Column, target: str, k: int, out: str) -> DataFrame:
    """Folds inside any number of classes: a class's turn is the number of rows in classes before it."""
    table = size_table(df, target)
    top = table.agg(F.max("n")).first()[0]
    if k > top:
        raise ValueError(f"{k} folds need more than {top} rows in a class")
    placed = rank_values(table, "g", "place", with_bucket=True)
    sums = placed.groupBy("__b").agg(F.sum("n").alias("s")).orderBy("__b").collect()
    starts, run = {}, 0
    for r in sums:
        starts[r["__b"]] = run
        run += r["s"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("__b"))
    turns = placed.select(F.col("g").alias("__key"), "n", F.col("n").alias("__size"), F.pmod(before + start, F.lit(k)).alias("__turn"))
    ranked = rank_in_group(df, h, target, "__rank")
    joined = lookup_join(ranked, turns, group_text(target))
    # fold i holds size // k rows, one more if its place after the turn is among the odd ones
    size = lambda i: F.floor(F.col("__size") / k) + (F.pmod(F.lit(i) - F.col("__turn"), F.lit(k)) < F.col("__size") % k).cast("int")
    fold, upto = F.lit(0), F.lit(0)
    for i in range(k - 1):
        upto = upto + size(i)
        fold = fold + (F.col("__rank") >= upto).cast("int")
    return joined.withColumn(out, fold.cast("int")).select(*[col(c) for c in df.columns], out)


def deal(loads: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Runs (first, end, folds) of ``count`` equal groups, each into the lightest fold (the lowest on ties); updates the loads.

    Within a run the groups go round the folds in turn, so a run is told by three numbers however many groups it has.
    """
    runs, at = [], 0
    while at < count:
        order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
        low = loads[order[0]]
        turn = [i for i in order if loads[i] < low + size or (loads[i] == low + size and i < order[0])]
        outside = [loads[i] for i in order if i not in turn]
        rounds = max(1, -(-(min(outside) - low - size) // size)) if outside else -(-(count - at) // len(turn))
        n = min(count - at, rounds * len(turn))
        runs.append((at, at + n, turn))
        for j, i in enumerate(turn):
            loads[i] += size * (n // len(turn) + (j < n % len(turn)))
        at += n
    return runs


def kfold_group(df: DataFrame, group: str, n_splits: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Whole groups per fold: the largest group first, equal ones by hash, each into the lightest fold (the lowest on ties).

    The driver sees how many groups there are of each size. Groups of a size are ranked by hash as a table and dealt by
    their rank; the rule is the same for any number of groups.
    """
    groups = size_table(df, group).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["n"]: r["k"] for r in groups.groupBy("n").agg(F.count("*").alias("k")).collect()}
        if sum(sizes.values()) < n_splits:
            raise ValueError(f"{n_splits} folds need at least as many groups")
        loads, runs = [0] * n_splits, []
        for s in sorted(sizes, reverse=True):
            runs += [(s, a, b, turn) for a, b, turn in deal(loads, s, sizes[s])]
        ranked = rank_in_group(groups, F.md5(F.concat_ws("|", "g", F.lit(str(seed)))), "n", "rank")
        table = df.sparkSession.createDataFrame(runs, "n long, first long, end long, turn array<int>")
        inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
        fold = F.get("turn", F.pmod(F.col("rank") - F.col("first"), F.size("turn")).cast("int"))
        placed = ranked.join(F.broadcast(table), "n").where(inside).select(F.col("g").alias("__key"), "n", fold.alias("__fold"))
        joined = lookup_join(df, placed, group_text(group))
        return joined.withColumn(out, F.col("__fold")).select(*[col(c) for c in df.columns], out)
    finally:
        groups.unpersist()


def split_summary(df: DataFrame, target: str, part: str = "part") -> DataFrame:
    """(part, class, rows, share): class shares on either side of a split."""
    counts = df.groupBy(col(part).alias("part"), col(target).cast("string").alias("class")).agg(F.count("*").alias("rows"))
    totals = df.groupBy(col(part).alias("part")).agg(F.count("*").alias("total"))
    return counts.join(totals, "part").select("part", "class", "rows", (F.col("rows") / F.col("total")).alias("share"))


def split_auto(df: DataFrame, keys: list[str], target: str | None = None, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified with a target column, random without."""
    if target is None or target not in df.columns:
        return split_random(df, keys, test_size, seed)
    return split_stratified(df, keys, target, test_size, seed)
