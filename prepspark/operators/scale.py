"""Scaling of numeric columns: fitted values in, column expressions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import num, num_sql, numeric_columns, one_row, real
from prepspark.functions.stats import quantiles, skew_expr


@dataclass(frozen=True)
class Scaling:
    """x -> (x - center) / spread per column."""

    center: dict[str, float]
    spread: dict[str, float]
    method: str


def _guard(spread: float | None) -> float:
    return 1.0 if not spread else float(spread)


def fit_scale(df: DataFrame, method: str = "standard", cols: list[str] | None = None, exclude: list[str] = (), exact: bool = True) -> Scaling:
    """``minmax``, ``standard`` (population deviation), ``robust`` (median, IQR) or ``auto``."""
    cols = numeric_columns(df, exclude) if cols is None else cols
    if method == "auto":
        method = choose_scaling(df, cols)
    if method == "minmax":
        got = one_row(df, {(f, c): a(num(c)) for c in cols for f, a in (("lo", F.min), ("hi", F.max))})
        center = {c: got[("lo", c)] or 0.0 for c in cols}
        spread = {c: _guard((got[("hi", c)] or 0.0) - center[c]) for c in cols}
    elif method == "standard":
        got = one_row(df, {(f, c): a(num(c)) for c in cols for f, a in (("m", F.avg), ("s", F.stddev_pop))})
        center = {c: got[("m", c)] or 0.0 for c in cols}
        spread = {c: _guard(got[("s", c)]) for c in cols}
    elif method == "robust":
        qs = quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}, exact)
        center = {c: qs[c][1] or 0.0 for c in cols}
        spread = {c: _guard((qs[c][2] or 0.0) - (qs[c][0] or 0.0)) for c in cols}
    else:
        raise ValueError(f"unknown scaling '{method}'")
    return Scaling(center, spread, method)


def apply_scale(df: DataFrame, s: Scaling) -> DataFrame:
    return df.withColumns({c: F.expr(f"({num_sql(c)} - {real(s.center[c])}) / {real(s.spread[c])}") for c in s.center}) if s.center else df


def unscale(df: DataFrame, s: Scaling) -> DataFrame:
    return df.withColumns({c: F.expr(f"{num_sql(c)} * {real(s.spread[c])} + {real(s.center[c])}") for c in s.center}) if s.center else df


def choose_scaling(df: DataFrame, cols: list[str]) -> str:
    """``robust`` if more than half of the columns have |skew| > 1, else ``standard``."""
    skews = one_row(df, {c: skew_expr(c) for c in cols})
    wide = sum(1 for v in skews.values() if v is not None and abs(v) > 1)
    return "robust" if wide > len(cols) * 0.5 else "standard"


def scale_minmax(df: DataFrame, cols: list[str] | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    return apply_scale(df, fit_scale(fit_on or df, "minmax", cols, exclude))


def scale_standard(df: DataFrame, cols: list[str] | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    return apply_scale(df, fit_scale(fit_on or df, "standard", cols, exclude))


def scale_robust(df: DataFrame, cols: list[str] | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    return apply_scale(df, fit_scale(fit_on or df, "robust", cols, exclude, exact))


def scale_normalize(
    df: DataFrame, method: str | None = "auto", cols: list[str] | None = None, exclude: list[str] = (),
    fit_on: DataFrame | None = None, exact: bool = True,
) -> DataFrame:
    """Scale by ``auto``, ``minmax``, ``standard`` or ``robust``; None leaves the table alone."""
    if method is None:
        return df
    return apply_scale(df, fit_scale(fit_on or df, method, cols, exclude, exact))
