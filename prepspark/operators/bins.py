"""Discretisation of numeric columns into ordinal bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import num, num_sql, numeric_columns, one_row, real
from prepspark.functions.stats import distinct_counts, quantiles
from prepspark.session import materialize

#: edges closer than this are one edge
EDGE_TOLERANCE = 1e-8
MAX_ROUNDS = 300
#: Quantile intervals of a column and equal parts of each, which hold its distinct values for k-means edges.
CELLS, SUB_CELLS = 32, 64
#: Values of one cell that are fetched; of larger ones only sums are.
FETCH_VALUES = 50_000


def bin_expr(name: str, edges: list[float]) -> Column:
    """Number of interior edges at or below the value; null stays null."""
    return F.expr(bin_sql(name, edges))


def bin_sql(name: str, edges: list[float]) -> str:
    x = num_sql(name)
    steps = " + ".join([f"cast({x} >= {real(e)} AS int)" for e in edges[1:-1]] or ["0"])
    return f"CASE WHEN {x} IS NOT NULL THEN {steps} END"


def quantile_edges(df: DataFrame, cols: list[str], n_bins: int = 5, exact: bool = True) -> dict[str, list[float]]:
    qs = quantiles(df, {c: [i / n_bins for i in range(n_bins + 1)] for c in cols}, exact)
    out = {}
    for c, edges in qs.items():
        kept = [edges[0]]
        kept += [b for a, b in zip(edges, edges[1:]) if b is not None and b - a > EDGE_TOLERANCE]
        out[c] = kept
    return out


def uniform_edges(df: DataFrame, cols: list[str], n_bins: int = 5) -> dict[str, list[float]]:
    got = one_row(df, {(f, c): a(num(c)) for c in cols for f, a in (("lo", F.min), ("hi", F.max))})
    out = {}
    for c in cols:
        lo, hi = got[("lo", c)] or 0.0, got[("hi", c)] or 0.0
        out[c] = [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]
    return out


class _Moments:
    """Rows and sum of a column below any border, from its distinct values in ordered cells.

    Cell totals lie on the driver (a fixed number per column); the values themselves stay a table. A border asks for the
    values of its own cell only: they are fetched once if they are few, else summed by a small job on that cell.
    """

    def __init__(self, values: DataFrame, edges: list[float], cells: dict[int, tuple[int, float, int]]):
        self.values, self.edges = values, edges
        self.ids = np.array(sorted(cells), dtype=np.int64)
        self.n, self.s = (np.concatenate(([0.0], np.cumsum([cells[i][k] for i in self.ids]))) for k in (0, 1))
        self.distinct = {i: c[2] for i, c in cells.items()}
        self.fetched: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def cell(self, x: float) -> int:
        """As ``_cell_sql`` tells for a value."""
        k = max(0, min(sum(e <= x for e in self.edges) - 1, len(self.edges) - 2))
        width = self.edges[k + 1] - self.edges[k]
        inner = int((x - self.edges[k]) / width * SUB_CELLS) if width > 0 else 0
        return k * SUB_CELLS + max(0, min(SUB_CELLS - 1, inner))

    def below(self, border: float) -> tuple[float, float]:
        """(rows, sum) of the values below the border."""
        cell = self.cell(border)
        at = int(np.searchsorted(self.ids, cell))
        n, s = self.n[at], self.s[at]
        if at == len(self.ids) or self.ids[at] != cell:
            return n, s
        mine = self.values.where(F.col("cell") == cell)
        if self.distinct[cell] > FETCH_VALUES:
            got = mine.where(F.col("x") < F.lit(border)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("x")), F.lit(0.0))).first()
            return n + got[0], s + got[1]
        if cell not in self.fetched:
            rows = sorted((r["x"], r["n"]) for r in mine.select("x", "n").collect())
            x, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
            self.fetched[cell] = x, np.concatenate(([0.0], np.cumsum(m))), np.concatenate(([0.0], np.cumsum(m * x)))
        x, m, t = self.fetched[cell]
        k = int(np.searchsorted(x, border, side="left"))
        return n + m[k], s + t[k]


def _cell_sql(x: str, edges: list[float]) -> str:
    """Cell of a value: ``SUB_CELLS`` equal parts of the interval of the edges that it lies in. Cells are ordered as values are."""
    listed = f"array({', '.join(real(e) for e in edges)})"
    k = f"greatest(0, least(size(filter({listed}, e -> e <= {x})) - 1, {len(edges) - 2}))"
    lo, hi = f"element_at({listed}, k + 1)", f"element_at({listed}, k + 2)"
    inner = f"CASE WHEN {hi} > {lo} THEN greatest(0, least({SUB_CELLS - 1}, cast(({x} - {lo}) / ({hi} - {lo}) * {SUB_CELLS} AS int))) ELSE 0 END"
    return f"transform(array({k}), k -> k * {SUB_CELLS} + {inner})[0]"


def kmeans_edges(df: DataFrame, cols: list[str], n_bins: int = 5, max_rounds: int = MAX_ROUNDS, tol: float = 1e-4) -> dict[str, list[float]]:
    """Edges halfway between sorted one-dimensional k-means centres.

    Centres start in the middle of equal-width bins and move by Lloyd rounds, so the result depends on the values only. In one
    dimension a cluster is an interval, so a round needs the rows and the sum below each border and no row again. The table is
    read twice whatever the rounds: once for range, variance and coarse quantiles, once for its distinct values, which are
    counted before they are shuffled and written by column and cell.
    """
    shares = ", ".join(str(i / CELLS) for i in range(CELLS + 1))
    aggs = {}
    for c in cols:
        x = num_sql(c)
        aggs |= {("lo", c): F.min(num(c)), ("hi", c): F.max(num(c)), ("var", c): F.var_pop(num(c)), ("q", c): F.expr(f"percentile_approx({x}, array({shares}), 1000)")}
    got = one_row(df, aggs)
    edges, centers = {}, {}
    for c in cols:
        lo, hi = got["lo", c] or 0.0, got["hi", c] or 0.0
        edges[c] = [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]
        centers[c] = [(a + b) / 2 for a, b in zip(edges[c], edges[c][1:])]
    moving = [c for c in cols if got["var", c]]
    if moving:
        moments = _moments(df, {c: sorted({got["lo", c], *got["q", c], got["hi", c]}) for c in moving})
    for _ in range(max_rounds):
        if not moving:
            break
        still = []
        for c in moving:
            old = centers[c]
            cuts = [moments[c].below((a + b) / 2) for a, b in zip(old, old[1:])]
            cuts = [(0.0, 0.0), *cuts, (moments[c].n[-1], moments[c].s[-1])]
            new = sorted((s1 - s0) / (n1 - n0) if n1 > n0 else old[i] for i, ((n0, s0), (n1, s1)) in enumerate(zip(cuts, cuts[1:])))
            shift = sum((a - b) ** 2 for a, b in zip(new, old))
            centers[c] = new
            if shift > tol * got["var", c]:
                still.append(c)
        moving = still
    return {c: [edges[c][0], *[(a + b) / 2 for a, b in zip(centers[c], centers[c][1:])], edges[c][-1]] for c in cols}


def _moments(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, _Moments]:
    cells = ", ".join(f"named_struct('c', {i}, 'cell', {_cell_sql(num_sql(c), e)}, 'x', {num_sql(c)})" for i, (c, e) in enumerate(edges.items()))
    tall = df.select(F.explode(F.expr(f"array({cells})")).alias("v")).select("v.*").where("x IS NOT NULL")
    values = materialize(tall.groupBy("c", "cell", "x").agg(F.count("*").alias("n")).repartitionByRange("c", "cell").sortWithinPartitions("c", "cell"), "distinct-values")
    found: dict[int, dict[int, tuple[int, float, int]]] = {i: {} for i in range(len(edges))}
    for r in values.groupBy("c", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.count("*").alias("d")).toLocalIterator():
        found[r["c"]][r["cell"]] = (r["n"], r["s"], r["d"])
    return {c: _Moments(values.where(F.col("c") == i), e, found[i]) for i, (c, e) in enumerate(edges.items())}


def fit_bins(df: DataFrame, cols: list[str], n_bins: int = 5, strategy: str = "quantile", exact: bool = True) -> dict[str, list[float]]:
    if strategy == "quantile":
        return quantile_edges(df, cols, n_bins, exact)
    if strategy == "uniform":
        return uniform_edges(df, cols, n_bins)
    if strategy == "kmeans":
        return kmeans_edges(df, cols, n_bins)
    raise ValueError(f"unknown strategy '{strategy}'")


def apply_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    return df.withColumns({c: bin_expr(c, e) for c, e in edges.items()}) if edges else df


def bin_discretize(
    df: DataFrame, n_bins: int = 5, strategy: str = "quantile", cols: list[str] | None = None, exclude: list[str] = (),
    fit_on: DataFrame | None = None, exact: bool = True,
) -> DataFrame:
    """Bin numeric columns that have more than 2 * n_bins distinct values (all given ones if ``cols`` is set)."""
    source = fit_on or df
    if cols is None:
        numeric = numeric_columns(df, exclude)
        nd = distinct_counts(source, numeric, exact=False) if numeric else {}
        near = [c for c in numeric if nd[c] <= 4 * n_bins + 8]
        nd.update(distinct_counts(source, near) if near else {})
        cols = [c for c in numeric if nd[c] > 2 * n_bins]
    return apply_bins(df, fit_bins(source, cols, n_bins, strategy, exact)) if cols else df


def bin_quantile(df: DataFrame, cols: list[str] | None = None, n_bins: int = 5, exact: bool = True) -> DataFrame:
    return bin_discretize(df, n_bins, "quantile", cols, exact=exact)


def bin_uniform(df: DataFrame, cols: list[str] | None = None, n_bins: int = 5) -> DataFrame:
    return bin_discretize(df, n_bins, "uniform", cols)


def bin_kmeans(df: DataFrame, cols: list[str] | None = None, n_bins: int = 5) -> DataFrame:
    return bin_discretize(df, n_bins, "kmeans", cols)
