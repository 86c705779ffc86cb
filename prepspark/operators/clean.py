"""Missing values, duplicates, casts and before/after comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prepspark.functions.columns import (
    col, columns_of, is_missing, kinds, nan_to_null, num, numeric_columns, one_row, ref, total,
)
from prepspark.functions.stats import medians

NUMERIC_FILLS = ("mean", "median")


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without any missing cell."""
    return df.na.drop("any", subset=subset)


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace missing cells; integer columns become double where the value is fractional."""
    filled = {}
    for c, v in values.items():
        if v is None:
            continue
        if kinds(df)[c] == "numeric":
            whole = dict(df.dtypes)[c] not in ("float", "double") and float(v) == int(v)
            filled[c] = F.coalesce(col(c), F.lit(int(v)).cast(dict(df.dtypes)[c])) if whole else F.coalesce(num(c), F.lit(float(v)))
        else:
            filled[c] = F.coalesce(col(c), F.lit(v))
    return df.withColumns(filled) if filled else df


def fit_fill(
    df: DataFrame, numeric: list[str], other: list[str], numeric_with: str = "median", exact: bool = True,
) -> dict[str, object]:
    """Fill value per column: mean, median or mode of numeric columns, mode of the others."""
    values: dict[str, object] = {}
    if numeric_with == "mean":
        values.update(one_row(df, {c: F.avg(num(c)) for c in numeric}))
    elif numeric_with == "median":
        values.update(medians(df, numeric, exact) if numeric else {})
    else:
        values.update(modes(df, numeric))
    found = modes(df, other)
    values.update({c: found[c] if found[c] is not None else "missing" for c in other if kinds(df)[c] == "string"})
    values.update({c: found[c] for c in other if kinds(df)[c] != "string" and found[c] is not None})
    return values


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties.

    Counted by grouped aggregations (one for all text columns) rather than the
    ``mode`` aggregate, whose single buffer would hold every distinct value.
    """
    out: dict[str, object] = {c: None for c in cols}
    texts = [c for c in cols if kinds(df)[c] == "string"]
    if texts:
        cells = ", ".join(f"named_struct('c', {i}, 'v', {ref(c)})" for i, c in enumerate(texts))
        counts = df.select(F.expr(f"inline(array({cells}))")).where("v IS NOT NULL").groupBy("c", "v").count()
        for r in counts.groupBy("c").agg(F.min(F.struct(-F.col("count"), "v")).alias("best")).collect():
            out[texts[r["c"]]] = r["best"]["v"]
    for c in [c for c in cols if c not in texts]:
        counts = df.where(~is_missing(df, c)).groupBy(col(c).alias("v")).count()
        row = counts.orderBy(F.desc("count"), "v").limit(1).collect()
        out[c] = row[0]["v"] if row else None
    return out


def impute_mean(df: DataFrame, cols: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    cols = numeric_columns(df) if cols is None else cols
    return _fill(df, fit_fill(fit_on or df, cols, [], "mean"))


def impute_median(df: DataFrame, cols: list[str] | None = None, fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    cols = numeric_columns(df) if cols is None else cols
    return _fill(df, fit_fill(fit_on or df, cols, [], "median", exact))


def impute_mode(df: DataFrame, cols: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    cols = [c for c, k in kinds(df).items() if k in ("string", "boolean", "datetime")] if cols is None else cols
    numeric = [c for c in cols if kinds(df)[c] == "numeric"]
    return _fill(df, fit_fill(fit_on or df, numeric, [c for c in cols if c not in numeric], "mode"))


def missing_shares(df: DataFrame) -> dict[str, float]:
    got = one_row(df, {"__n": F.count("*"), **{c: F.count_if(is_missing(df, c)) for c in df.columns}})
    n = max(1, got.pop("__n"))
    return {c: v / n for c, v in got.items()}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Drop columns with more than the given share of missing cells."""
    shares = missing_shares(df)
    return df.drop(*[c for c in df.columns if shares[c] > threshold])


def impute_auto(df: DataFrame, threshold: float = 0.3, exact: bool = True) -> DataFrame:
    """Drop sparse columns, then median for numeric and mode for other columns that miss cells."""
    shares = missing_shares(df)
    kept = df.drop(*[c for c in df.columns if shares[c] > threshold])
    gaps = [c for c in kept.columns if shares[c] > 0]
    ks = kinds(kept)
    numeric = [c for c in gaps if ks[c] == "numeric"]
    other = [c for c in gaps if ks[c] in ("string", "boolean", "datetime")]
    return _fill(kept, fit_fill(kept, numeric, other, "median", exact))


def handle_missing(df: DataFrame, strategy: str = "auto", exact: bool = True) -> DataFrame:
    """``auto``, ``drop``, ``mean``, ``median`` or ``mode`` (the last three on numeric columns)."""
    if strategy == "auto":
        return impute_auto(df, exact=exact)
    if strategy == "drop":
        return drop_null_rows(df)
    if strategy == "mean":
        return impute_mean(df)
    if strategy == "median":
        return impute_median(df, exact=exact)
    if strategy == "mode":
        return impute_mode(df, numeric_columns(df))
    raise ValueError(f"unknown strategy '{strategy}'")


def dedup_rows(df: DataFrame) -> DataFrame:
    """One of each set of fully equal rows."""
    return df.dropDuplicates()


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; a column with any value that does not convert stays as it was."""
    casts = {c: col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    if not casts:
        return df
    lost = one_row(df, {c: F.count_if(col(c).isNotNull() & e.isNull()) for c, e in casts.items()})
    good = {c: e for c, e in casts.items() if lost[c] == 0}
    return df.withColumns(good) if good else df


@dataclass(frozen=True)
class CleaningFit:
    """What the mean policy decided on a table: to drop incomplete rows, or which value fills which column."""

    drop_rows: bool
    fills: dict[str, float]


def fit_cleaning(df: DataFrame) -> CleaningFit:
    """If any non-numeric cell is missing, rows with a missing cell go; otherwise numeric gaps take the column mean. One pass."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    got = one_row(df, {**{("gap", c): F.count_if(is_missing(df, c)) for c in df.columns}, **{("mean", c): F.avg(num(c)) for c in numeric}})
    if any(got[("gap", c)] for c in df.columns if c not in numeric):
        return CleaningFit(True, {})
    return CleaningFit(False, {c: got[("mean", c)] for c in numeric if got[("gap", c)] and got[("mean", c)] is not None})


def apply_cleaning(df: DataFrame, fit: CleaningFit) -> DataFrame:
    """A narrow step, so a stream takes it as well as a table; duplicates stay."""
    df = nan_to_null(df)
    return drop_null_rows(df) if fit.drop_rows else _fill(df, fit.fills)


def clean_policy(
    df: DataFrame, strategy: str = "mean", drop_duplicates: bool = True, types: dict[str, str] | None = None,
) -> DataFrame:
    """Missing values, duplicates, casts.

    With ``mean``: if any non-numeric cell is missing, all rows with a missing
    cell go; otherwise numeric gaps take the column mean. Other strategies are
    those of ``handle_missing``; None leaves missing cells alone.
    """
    df = nan_to_null(df)
    if strategy == "mean":
        df = apply_cleaning(df, fit_cleaning(df))
    elif strategy is not None:
        df = handle_missing(df, strategy)
    if drop_duplicates:
        df = dedup_rows(df)
    return cast_columns(df, types) if types else df


def drop_nested_columns(df: DataFrame) -> DataFrame:
    """Drop array, map and struct columns; known from the schema, no scan."""
    return df.drop(*columns_of(df, "nested"))


def table_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(item, value): rows removed, keys lost and new, columns lost, differing cells per common column.

    The rows of a key are two multisets. Equal rows cancel out; what is left on both sides is paired in order of its
    digests, and paired rows are compared cell by cell. Rows without a partner count in ``rows_removed``, not as cells.
    Distinct rows are counted first, so copies collapse before the shuffle; only rows that differ are ranked and joined.
    """
    common = [c for c in before.columns if c in after.columns and c not in keys]
    lost = [c for c in before.columns if c not in after.columns]
    # cells travel as digests: any type can be compared, and long texts stay at home
    digest = lambda cols: F.md5(F.to_json(F.struct(*[col(c) for c in cols])))
    cells = F.array(*[digest([c]) for c in common]) if common else F.array().cast("array<string>")
    shape = lambda df, side: df.select(digest(keys).alias("__key"), cells.alias("__row"), F.lit(side).alias("__side"))
    both = shape(before, 1).unionByName(shape(after, -1))
    rows = both.groupBy("__key", "__row").agg(
        F.sum("__side").alias("net"), F.count_if(F.col("__side") == 1).alias("n0"), F.count_if(F.col("__side") == -1).alias("n1"))
    per_key = rows.groupBy("__key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = per_key.agg(
        F.coalesce(F.sum(F.col("n0") - F.col("n1")), F.lit(0)).alias("rows_removed"),
        F.count_if(F.col("n1") == 0).alias("keys_lost"), F.count_if(F.col("n0") == 0).alias("keys_new"))

    def left(sign: int) -> DataFrame:
        some = rows.where(F.col("net") * sign > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("net").cast("int"))))
        at = F.row_number().over(Window.partitionBy("__key").orderBy("__row", "copy"))
        return some.select("__key", F.col("__row").alias("a" if sign > 0 else "b"), at.alias("at"))

    pairs = left(1).join(left(-1), ["__key", "at"])
    sums = pairs.agg(*[F.count_if(F.get("a", F.lit(i)) != F.get("b", F.lit(i))).alias(f"__d{i}") for i in range(len(common))], F.count("*").alias("__pairs"))
    items = lambda row, values: row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("item"), v.cast("long").alias("value")) for i, v in values])).alias("r")).select("r.*")
    cells_of = [F.col(f"__d{i}") for i in range(len(common))]
    return items(totals, [
        ("rows_removed", F.col("rows_removed")), ("keys_lost", F.col("keys_lost")), ("keys_new", F.col("keys_new")), ("columns_lost", F.lit(len(lost))),
    ]).unionByName(items(sums, [
        ("different_cells", total(cells_of) if common else F.lit(0)), *[(f"different:{c}", v) for c, v in zip(common, cells_of)],
    ]))
