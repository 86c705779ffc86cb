"""Column typing and small expression helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def ref(name: str) -> str:
    """A column's literal name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def real(value: float) -> str:
    """A double as SQL text, bit for bit."""
    value = float(value)
    if math.isfinite(value):
        return f"({value!r}D)"
    return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"


def col(name: str) -> Column:
    """Column by its literal name.

    Expressions over many columns are put together as SQL text and parsed once:
    a Column built operator by operator costs a call to the JVM each.
    """
    return F.expr(ref(name))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, NESTED_TYPES):
        return "nested"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [name for name, k in kinds(df).items() if k == kind and name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, "numeric", exclude)


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, "string", exclude)


def datetime_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, "datetime", exclude)


def num_sql(name: str) -> str:
    """Numeric column as double, NaN read as missing."""
    return f"nanvl(cast({ref(name)} AS double), cast(NULL AS double))"


def num(name: str) -> Column:
    return F.expr(num_sql(name))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.expr(f"{ref(name)} IS NULL" + (f" OR isnan({ref(name)})" if floating else ""))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN cells of floating columns to null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def total(exprs: list[Column]) -> Column:
    """Sum of expressions; 0 for an empty list."""
    out = F.lit(0)
    for e in exprs:
        out = out + e
    return out


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Run one global aggregation and return its single row as a dict."""
    if not exprs:
        return {}
    keys = list(exprs)
    row = df.agg(*[exprs[k].alias(f"a{i}") for i, k in enumerate(keys)]).first()
    return {k: row[i] for i, k in enumerate(keys)}


def stack_rows(df: DataFrame, per_column: dict[str, dict[str, Column]], label: str = "column") -> DataFrame:
    """Tidy rows from one global aggregation.

    ``per_column`` maps a column name to its named aggregates; the aggregation
    runs once over ``df`` and its single row is exploded to one row per column.
    """
    names = list(per_column)
    fields = list(next(iter(per_column.values())))
    aggs = [per_column[n][f].alias(f"a{i}_{j}") for i, n in enumerate(names) for j, f in enumerate(fields)]
    row = df.agg(*aggs)
    structs = [
        F.struct(F.lit(n).alias(label), *[F.col(f"a{i}_{j}").alias(f) for j, f in enumerate(fields)])
        for i, n in enumerate(names)
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes in fewer pieces than there are cores; no change otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
