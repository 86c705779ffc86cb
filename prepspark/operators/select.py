"""Feature scores and selection."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prepspark.functions.columns import col, kinds, num, num_sql, numeric_columns, one_row, real, stack_rows
from prepspark.functions.stats import corr_sql, distinct_counts

# tasks carry this module's code with them: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: beyond this many columns scores are aggregated as matrices
WIDE_COLUMNS = 24
#: columns of one matrix: few enough for the columnar reader and for generated code that the JVM compiles
BLOCK_COLUMNS = 32
#: (class, column) cells a task holds before it hands them on
HELD_CELLS = 1_000_000


def _value_sql(name: str, fill: float | None) -> str:
    return num_sql(name) if fill is None else f"coalesce({num_sql(name)}, {real(fill)})"


def _value(name: str, fill: float | None) -> Column:
    return F.expr(_value_sql(name, fill))


def _moments(batches: Iterator[pa.RecordBatch], names: list[str], shift: list[float], fill: float | None) -> Iterator[pa.RecordBatch]:
    """(feature, t, n, m, q): count, mean and squared deviations of the columns after the first, which holds the class.

    Nulls and NaN count as ``fill``, or not at all; ``shift`` is taken off every cell.
    """
    held: dict[str, list[np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for t, (n, m, q) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([t] * len(names), pa.string()), pa.array(n), pa.array(m), pa.array(q)], names=["feature", "t", "n", "m", "q"])
        held.clear()

    with np.errstate(all="ignore"):
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes = groups.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            x = np.stack([batch.column(i + 1).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)[order]
            gone = np.isnan(x)
            x = np.where(gone, 0.0 if fill is None else fill - np.array(shift), x - np.array(shift))
            ones = np.ones(x.shape) if fill is not None else (~gone).astype(float)
            ends = [*starts[1:].tolist(), len(order)]
            for a, b in zip(starts.tolist(), ends, strict=True):
                n, there = ones[a:b].sum(axis=0), ones[a:b] > 0
                # relative to the first cell: equal cells have no deviation at all
                base = x[a + there.argmax(axis=0), np.arange(x.shape[1])]
                off = np.where(there, x[a:b] - base, 0.0)
                mean = off.sum(axis=0) / np.maximum(n, 1)
                m, q = base + mean, np.where(there, (off - mean) ** 2, 0.0).sum(axis=0)
                t = groups.dictionary[int(codes[order[a]])].as_py()
                if t in held:
                    n0, m0, q0 = held[t]
                    total = np.maximum(n0 + n, 1)
                    n, m, q = n0 + n, m0 + np.where(n > 0, (m - m0) * n / total, 0.0), q0 + q + (m - m0) ** 2 * n0 * n / total
                held[t] = [n, m, q]
            # classes without end leave the task's memory
            if len(held) * len(names) > HELD_CELLS:
                yield from rows()
    yield from rows()


def _class_moments(df: DataFrame, target: str, cols: list[str], fill: float | None) -> DataFrame:
    """(feature, n, v, d) per class: count, variance and distance of the mean from the overall one, a block of columns per pass.

    Cells are taken relative to those of some row, so that a far offset costs no digits.
    """
    kind = df.schema[target].dataType
    group = col(target) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(target)
    some = df.select(*[_value(c, fill).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    shift = [v if v is not None and np.isfinite(v) else 0.0 for v in (some or [None] * len(cols))]
    parts = None
    for at in range(0, len(cols), BLOCK_COLUMNS):
        names = cols[at:at + BLOCK_COLUMNS]
        # plain columns: the code of many expressions in one method is too long to be compiled
        cells = df.select(group.cast("string").alias("t"), *[
            (num(c) if isinstance(df.schema[c].dataType, T.DecimalType) else col(c)).alias(f"x{i}") for i, c in enumerate(names)])
        one = cells.mapInArrow(
            lambda batches, names=names, at=at: _moments(batches, names, shift[at:at + len(names)], fill), "feature string, t string, n double, m double, q double")
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.where("n > 0")
    by_class, by_feature = Window.partitionBy("feature", "t"), Window.partitionBy("feature")
    centre = lambda w: F.min("m").over(w) + F.sum(F.col("n") * (F.col("m") - F.col("lo"))).over(w) / F.sum("n").over(w)
    near = parts.withColumn("lo", F.min("m").over(by_class)).withColumn("c", centre(by_class))
    near = near.withColumn("lo", F.min("m").over(by_feature)).withColumn("d", F.col("c") - centre(by_feature))
    apart = F.col("m") - F.col("c")
    return near.groupBy("feature", "t").agg(
        F.sum("n").alias("n"), F.max("d").alias("d"), (F.sum(F.col("q") + F.col("n") * apart * apart) / F.sum("n")).alias("v"))


def f_classif(df: DataFrame, target: str, cols: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """(feature, score): ANOVA F of every numeric feature against the classes.

    Per-class count, mean and population variance come from one grouped
    aggregation; the between and within sums of squares follow from those rows,
    with deviations taken from the overall mean.
    """
    cols = numeric_columns(df, [target]) if cols is None else cols
    known = df.where(col(target).isNotNull())
    if len(cols) <= WIDE_COLUMNS:
        overall = one_row(known, {c: F.avg(_value(c, fill)) for c in cols})
        aggs = []
        for i, c in enumerate(cols):
            x = _value(c, fill)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
        per_class = known.groupBy(col(target)).agg(*aggs)
        fields = F.array(*[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v"),
                (F.col(f"m{i}") - F.lit(overall[c])).alias("d"),
            )
            for i, c in enumerate(cols)
        ])
        tidy = per_class.select(F.explode(fields).alias("r")).select("r.*")
    else:
        # hundreds of aggregates in one row outgrow generated code: blocks of columns are matrices inside the tasks
        tidy = _class_moments(known, target, cols, fill)
    tidy = tidy.where("n > 0")
    first = tidy.groupBy("feature").agg(
        F.sum("n").alias("nn"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ssb"),
    )
    score = F.when(
        (F.col("k") > 1) & (F.col("nn") > F.col("k")) & (F.col("ssw") > 0),
        (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("nn") - F.col("k"))),
    )
    return first.select("feature", score.alias("score"))


def f_regression(df: DataFrame, target: str, cols: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """(feature, score): r² / (1 - r²) * (n - 2), all correlations in one aggregation."""
    cols = numeric_columns(df, [target]) if cols is None else cols
    y = num(target)
    rows = stack_rows(df.where(y.isNotNull()), {
        c: {
            "r": F.expr(corr_sql(_value_sql(c, fill), num_sql(target))), "n": F.count(_value(c, fill)),
        } for c in cols
    }, "feature")
    r2 = F.col("r") * F.col("r")
    return rows.select("feature", F.when(r2 < 1, r2 / (1 - r2) * (F.col("n") - 2)).alias("score"))


def feature_scores(df: DataFrame, target: str, cols: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """F test by classes for a target that is no number or has up to 10 values, by regression otherwise."""
    few = kinds(df)[target] != "numeric" or distinct_counts(df, [target])[target] <= 10
    return (f_classif if few else f_regression)(df, target, cols, fill)


def select_k_best(df: DataFrame, target: str, k: int = 20, exclude: list[str] = ()) -> DataFrame:
    """Keep the k best numeric features in input order, besides target, excluded and non-numeric columns.

    Missing cells count as 0. Ties go to the later column. With k or fewer
    numeric features the table is returned as it is.
    """
    numeric = numeric_columns(df, [target, *exclude])
    if len(numeric) <= k:
        return df
    scores = {r["feature"]: r["score"] for r in feature_scores(df, target, numeric, 0.0).collect()}
    order = sorted(range(len(numeric)), key=lambda i: (scores.get(numeric[i]) is None, -(scores.get(numeric[i]) or 0.0), -i))
    best = {numeric[i] for i in order[:k]}
    features = [F.coalesce(num(c), F.lit(0.0)).alias(c) for c in numeric if c in best]
    return df.select(*features, *[col(c) for c in df.columns if c not in numeric])


def variances(df: DataFrame, cols: list[str]) -> dict[str, float]:
    return one_row(df, {c: F.var_pop(num(c)) for c in cols})


def variance_threshold(df: DataFrame, threshold: float = 0.01, exclude: list[str] = ()) -> DataFrame:
    """Drop numeric columns whose population variance is at or below the threshold."""
    numeric = numeric_columns(df, exclude)
    got = variances(df, numeric)
    return df.drop(*[c for c in numeric if (got[c] or 0.0) <= threshold])


def select_features(df: DataFrame, target: str | None = None, k: int = 10) -> DataFrame:
    """``select_k_best`` with a target, ``variance_threshold`` without; untouched with k or fewer numeric columns."""
    if len(numeric_columns(df, [target] if target else [])) <= k:
        return df
    return select_k_best(df, target, k) if target and target in df.columns else variance_threshold(df)
