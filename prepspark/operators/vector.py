"""Numeric vectors from mixed tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, columns_of, numeric_columns, string_columns
from prepspark.functions.ranks import rank_values
from prepspark.operators.encode import Categories, attach, fit_categories, onehot_columns
from prepspark.operators.scale import apply_scale, fit_scale


def vectorize(
    df: DataFrame, exclude: list[str] = (), max_categories: int | None = None, fit_on: DataFrame | None = None, as_array: bool = False,
) -> DataFrame:
    """``features``: standardised numeric columns, flags, then dummies of the string columns.

    Excluded columns (keys, target) stay beside the vector. With ``max_categories`` a string column with more
    values is an error. All string columns are counted in one pass.
    """
    source = fit_on or df
    numeric = numeric_columns(df, exclude)
    flags = columns_of(df, "boolean", exclude)
    scaled = apply_scale(df, fit_scale(source, "standard", numeric))
    parts = [F.coalesce(col(c), F.lit(0.0)) for c in numeric] + [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in flags]
    fits = fit_categories(source, string_columns(df, exclude), null_as=None)
    for c, fit in fits.items():
        if max_categories is not None and fit.distinct > max_categories:
            raise ValueError(f"column '{c}' has more than {max_categories} values: use a frequency or label encoding")
        parts += list(onehot_columns(c, fit.values()).values())
    names = [f"__x{i}" for i in range(len(parts))]
    wide = scaled.select(*[col(c) for c in exclude], *[e.cast("double").alias(n) for e, n in zip(parts, names)])
    out = VectorAssembler(inputCols=names, outputCol="features").transform(wide).select(*[col(c) for c in exclude], "features")
    return out.withColumn("features", vector_to_array("features")) if as_array else out


def _layout(numeric: list[str], flags: list[str], fits: dict[str, Categories]) -> tuple[dict[str, int], int]:
    """First place of every text column and the size of the vector; the first value of a column has no place."""
    starts, at = {}, len(numeric) + len(flags)
    for c, fit in fits.items():
        starts[c] = at
        at += max(0, fit.distinct - 1)
    return starts, at


def value_index(df: DataFrame, exclude: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """(column, value, index): places of the values of the text columns in ``vectorize_sparse``; numeric columns and flags come first.

    Values are ranked where they lie; however many there are, none but those of short lists passes the driver.
    """
    numeric, flags = numeric_columns(df, exclude), columns_of(df, "boolean", exclude)
    fits = fit_categories(df, string_columns(df, exclude), null_as=None, max_rows=max_rows)
    starts, _ = _layout(numeric, flags, fits)
    out = df.sparkSession.createDataFrame(
        [*((c, None, i) for i, c in enumerate([*numeric, *flags])), *((c, v[0], starts[c] + k - 1) for c, fit in fits.items() if fit.rows is not None for k, v in enumerate(fit.rows) if k)],
        "column string, value string, index bigint")
    for c, fit in fits.items():
        if fit.rows is None:
            ranked = rank_values(fit.table, "__key", "__code").where("__code > 0")
            out = out.unionByName(ranked.select(F.lit(c).alias("column"), F.col("__key").alias("value"), (F.col("__code") + starts[c] - 1).cast("bigint").alias("index")))
    return out


def vectorize_sparse(df: DataFrame, exclude: list[str] = (), fit_on: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Excluded columns, ``size``, ``indices`` and ``values``: the vector of ``vectorize`` without its zeros, indices ascending.

    A text value becomes its rank by a lookup (broadcast if the table is small, else by shuffle with hot values apart), not by an
    expression per value, so columns may have any number of values. Nulls and values unseen in ``fit_on`` have no entry.
    """
    source = fit_on or df
    numeric, flags = numeric_columns(df, exclude), columns_of(df, "boolean", exclude)
    out = apply_scale(df, fit_scale(source, "standard", numeric))
    fits = fit_categories(source, string_columns(df, exclude), null_as=None, max_rows=max_rows)
    starts, size = _layout(numeric, flags, fits)
    cells = [F.struct(F.lit(i).cast("bigint").alias("i"), F.coalesce(col(c).cast("double"), F.lit(0.0)).alias("v")) for i, c in enumerate([*numeric, *flags])]
    for k, (c, fit) in enumerate(fits.items()):
        out = attach(out, col(c).cast("string"), fit, f"__{k}_").drop(f"__{k}_freq", f"__{k}_stat")
        code = F.col(f"__{k}_code")
        cells.append(F.struct((code + starts[c] - 1).cast("bigint").alias("i"), F.when(code > 0, 1.0).otherwise(0.0).alias("v")))
    cells = F.filter(F.array(*cells), lambda x: x["v"] != 0) if cells else F.expr("CAST(array() AS array<struct<i: bigint, v: double>>)")
    out = out.withColumn("__cells", cells)
    return out.select(*[col(c) for c in exclude], F.lit(size).cast("bigint").alias("size"), F.col("__cells.i").alias("indices"), F.col("__cells.v").alias("values"))
