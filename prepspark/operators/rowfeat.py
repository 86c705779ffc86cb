"""Row-wise statistics, interactions and polynomial terms."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, is_missing, num, numeric_columns, total


def row_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``numeric_mean, _std, _sum, _min, _max, _range`` over the numeric cells of a row, nulls ignored."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return df
    zero = F.lit(0.0)
    xs = [num(c) for c in cols]
    n = total([x.isNotNull().cast("int") for x in xs])
    base = df.withColumns({"numeric_sum": total([F.coalesce(x, zero) for x in xs]).cast("double"), "__n": n})
    mean = F.when(F.col("__n") > 0, F.col("numeric_sum") / F.col("__n"))
    squares = total([F.coalesce((x - F.col("numeric_mean")) * (x - F.col("numeric_mean")), zero) for x in xs])
    lo, hi = (xs[0], xs[0]) if len(xs) == 1 else (F.least(*xs), F.greatest(*xs))
    out = base.withColumn("numeric_mean", mean).withColumns({
        "numeric_std": F.when(F.col("__n") > 1, F.sqrt(squares / (F.col("__n") - 1))).otherwise(zero),
        "numeric_min": lo, "numeric_max": hi, "numeric_range": hi - lo,
    })
    names = ["numeric_mean", "numeric_std", "numeric_sum", "numeric_min", "numeric_max", "numeric_range"]
    return out.select(*[col(c) for c in df.columns], *names)


def row_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``missing_count`` and ``missing_ratio`` over the input columns."""
    cols = df.columns if cols is None else cols
    count = total([is_missing(df, c).cast("int") for c in cols]).cast("int")
    return df.withColumns({"missing_count": count, "missing_ratio": count / F.lit(float(max(1, len(cols))))})


def _names(df: DataFrame, cols: list[str] | None) -> list[str]:
    return numeric_columns(df) if cols is None else cols


def interaction_columns(a: str, b: str) -> dict[str, Column]:
    x, y = num(a), num(b)
    return {
        f"{a}_times_{b}": x * y, f"{a}_div_{b}": x / F.when(y == 0, F.lit(1.0)).otherwise(y),
        f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y,
    }


def interactions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Product, quotient (divisor 0 read as 1), sum and difference of every pair of the given (or all) numeric columns."""
    added: dict[str, Column] = {}
    for a, b in combinations(_names(df, cols), 2):
        added.update(interaction_columns(a, b))
    return df.select("*", *[e.alias(n) for n, e in added.items()]) if added else df


def polynomial_columns(cols: list[str], degree: int = 2) -> dict[str, Column]:
    """Terms in order of degree, then of columns: x1..xn, x1², x1x2, ..."""
    out: dict[str, Column] = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            e = num(combo[0])
            for c in combo[1:]:
                e = e * num(c)
            out[f"poly_{len(out)}"] = e
    return out


def polynomial(df: DataFrame, cols: list[str] | None = None, degree: int = 2) -> DataFrame:
    """``poly_i`` over the given (or all) numeric columns; needs two."""
    cols = _names(df, cols)
    if len(cols) < 2:
        return df
    added = polynomial_columns(cols, degree)
    return df.select("*", *[e.alias(n) for n, e in added.items()])


def basic_features(df: DataFrame) -> DataFrame:
    """Row statistics and missing counts over the input columns (only with a numeric column)."""
    numeric = numeric_columns(df)
    return row_missing(row_stats(df, numeric), df.columns) if numeric else df


def interaction_features(df: DataFrame, cols: list[str] | None = None, with_polynomial: bool = False, degree: int = 2) -> DataFrame:
    cols = _names(df, cols)
    out = interactions(df, cols)
    return polynomial(out, cols, degree) if with_polynomial else out
