"""Calendar features of date and timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions import dates
from prepspark.functions.columns import col, datetime_columns


def part_columns(name: str, full: bool = False) -> dict[str, Column]:
    """Monday is day 0 of the week; the weekend starts at day 5."""
    c = col(name)
    out = {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "dayofweek": F.weekday(c),
        "is_weekend": F.weekday(c) >= 5, "quarter": F.quarter(c),
    }
    if full:
        out.update({
            "minute": F.minute(c), "second": F.second(c).cast("int"), "dayofyear": F.dayofyear(c),
            "is_month_start": F.dayofmonth(c) == 1, "is_month_end": c.cast("date") == F.last_day(c),
        })
    return {f"{name}_{k}": v for k, v in out.items()}


def _with_parts(df: DataFrame, cols: list[str] | None, full: bool) -> DataFrame:
    cols = datetime_columns(df) if cols is None else cols
    dates = {f for f, t in df.dtypes if t == "date"}
    added: dict[str, Column] = {}
    source = df
    for c in cols:
        if c in dates:
            source = source.withColumn(c, col(c).cast("timestamp"))
        added.update(part_columns(c, full))
    out = source.withColumns(added) if added else df
    return out.withColumns({c: col(c).cast("date") for c in cols if c in dates}) if dates & set(cols) else out


def datetime_parts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Year, month, day, hour, day of week, weekend flag, quarter."""
    return _with_parts(df, cols, False)


def datetime_parts_full(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """As ``datetime_parts`` plus minute, second, day of year, month start and end."""
    return _with_parts(df, cols, True)


def to_datetime_coerce(df: DataFrame, cols: list[str], fmt: str | None = None) -> DataFrame:
    """Parse text columns to timestamps; what does not parse becomes null.

    Without ``fmt`` the format of each column is found from all its cells (``dates.find_formats``): one aggregation for all columns.
    """
    if fmt is None:
        return dates.parse_columns(df, cols)
    return df.withColumns({c: F.try_to_timestamp(col(c), F.lit(fmt)) for c in cols})
