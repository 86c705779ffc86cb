"""Column statistics that hold their shape at any row count.

Exact quantiles of a continuous column cannot be taken with ``percentile`` once
the table is large: that aggregate keeps every distinct value of the column in
one buffer. ``select_ranks`` finds exact order statistics with a fixed-size
sketch per pass instead: a sketch proposes a bracket around the wanted rank, the
next aggregation counts exactly how many rows lie below, in and above it, and
the bracket shrinks by about three orders of magnitude per round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepspark.functions.columns import col, num, num_sql, one_row, real, ref

#: rows up to which one ``percentile`` buffer is allowed to hold a whole column
PERCENTILE_ROWS = 1_000_000
#: values of a bracket that may be sorted in one aggregation buffer
BRACKET_ROWS = 20_000
#: estimated distinct values up to which a set per task is counted
FEW_VALUES = 200
#: relative standard error of approximate distinct counts
SKETCH_ERROR = 0.05
#: sketch accuracy (relative rank error 1/accuracy)
SKETCH_ACCURACY = 10_000


@dataclass
class _Target:
    key: str
    expr: Column
    rank: int
    lo: object = None
    hi: object = None
    below: int = 0
    inside: int = 0
    value: object = None
    done: bool = False
    probe: list = field(default_factory=list)

    def within(self) -> Column:
        cond = self.expr.isNotNull()
        if self.lo is not None:
            cond = cond & (self.expr > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (self.expr < F.lit(self.hi))
        return cond


def select_ranks(
    df: DataFrame, wanted: dict[str, tuple[Column, list[int]]], sizes: dict[str, int] | None = None,
    bracket_rows: int | None = None,
) -> dict[str, dict[int, object]]:
    """Exact values at 0-based ranks of several orderable numeric expressions.

    ``wanted`` maps a key to (expression, ranks). Nulls do not count. Each round
    runs two global aggregations for all targets together; no rows are shuffled.
    """
    bracket_rows = BRACKET_ROWS if bracket_rows is None else bracket_rows
    if sizes is None:
        sizes = one_row(df, {k: F.count(e) for k, (e, _) in wanted.items()})
    targets = [
        _Target(k, e, r, inside=sizes[k]) for k, (e, ranks) in wanted.items() for r in sorted(set(ranks)) if 0 <= r < sizes[k]
    ]
    delta = 2.0 / SKETCH_ACCURACY
    open_ = targets
    while True:
        wide = [t for t in open_ if not t.done and t.inside > bracket_rows]
        if not wide:
            break
        sketches = {}
        for i, t in enumerate(wide):
            p = (t.rank - t.below) / max(1, t.inside - 1)
            grid = F.array(F.lit(max(0.0, p - delta)), F.lit(min(1.0, p + delta)))
            sketches[i] = F.percentile_approx(F.when(t.within(), t.expr), grid, SKETCH_ACCURACY)
        found = one_row(df, sketches)
        counts = {}
        for i, t in enumerate(wide):
            a, b = found[i]
            t.probe = [a, b]
            inside = t.within()
            counts[(i, "lt")] = F.count_if(inside & (t.expr < F.lit(a)))
            counts[(i, "eqa")] = F.count_if(inside & (t.expr == F.lit(a)))
            counts[(i, "mid")] = F.count_if(inside & (t.expr > F.lit(a)) & (t.expr < F.lit(b)))
            counts[(i, "eqb")] = F.count_if(inside & (t.expr == F.lit(b))) if b != a else F.count_if(F.lit(False))
        n = one_row(df, counts)
        for i, t in enumerate(wide):
            a, b = t.probe
            r = t.rank - t.below
            lt, eqa, mid, eqb = (n[(i, x)] for x in ("lt", "eqa", "mid", "eqb"))
            if r < lt:
                t.hi, t.inside = a, lt
            elif r < lt + eqa:
                t.value, t.done = a, True
            elif r < lt + eqa + mid:
                t.lo, t.hi, t.below, t.inside = a, b, t.below + lt + eqa, mid
            elif r < lt + eqa + mid + eqb:
                t.value, t.done = b, True
            else:
                skipped = lt + eqa + mid + eqb
                t.lo, t.below, t.inside = b, t.below + skipped, t.inside - skipped
    rest = [t for t in targets if not t.done]
    groups: dict[tuple, list[_Target]] = {}
    for t in rest:
        groups.setdefault((t.key, t.lo, t.hi), []).append(t)
    keys = list(groups)
    sorted_values = {
        i: F.array(*[
            F.get(F.sort_array(F.collect_list(F.when(groups[k][0].within(), groups[k][0].expr))), F.lit(t.rank - t.below))
            for t in groups[k]
        ])
        for i, k in enumerate(keys)
    }
    final = one_row(df, sorted_values)
    for i, k in enumerate(keys):
        for t, v in zip(groups[k], final[i]):
            t.value = v
    out: dict[str, dict[int, object]] = {k: {} for k in wanted}
    for t in targets:
        out[t.key][t.rank] = t.value
    return out


def quantiles(
    df: DataFrame, probs: dict[str, list[float]], exact: bool = True, n: int | None = None,
    percentile_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per numeric column.

    Exact by default. Tables up to ``percentile_rows`` use one ``percentile``
    aggregation; larger ones use ``select_ranks``. ``exact=False`` is one pass
    with a sketch.
    """
    limit = PERCENTILE_ROWS if percentile_rows is None else percentile_rows
    if not probs:
        return {}
    arrays = {c: F.array(*[F.lit(float(p)) for p in ps]) for c, ps in probs.items()}
    if not exact:
        got = one_row(df, {c: F.percentile_approx(num(c), a, SKETCH_ACCURACY) for c, a in arrays.items()})
        return {c: list(got[c]) if got[c] is not None else [None] * len(ps) for c, ps in probs.items()}
    if n is None:
        n = df.count()
    if n <= limit:
        got = one_row(df, {c: F.percentile(num(c), a) for c, a in arrays.items()})
        return {c: list(got[c]) if got[c] is not None else [None] * len(ps) for c, ps in probs.items()}
    sizes = one_row(df, {c: F.count(num(c)) for c in probs})
    ranks = {
        c: [r for p in ps for r in {math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1))}] if sizes[c] else []
        for c, ps in probs.items()
    }
    found = select_ranks(df, {c: (num(c), ranks[c]) for c in probs}, sizes)
    out: dict[str, list[float | None]] = {}
    for c, ps in probs.items():
        out[c] = []
        for p in ps:
            if not sizes[c]:
                out[c].append(None)
                continue
            pos = p * (sizes[c] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = found[c][lo], found[c][hi]
            out[c].append(a + (b - a) * (pos - lo))
    return out


def medians(df: DataFrame, cols: list[str], exact: bool = True, n: int | None = None) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in cols}, exact, n).items()}


def skew_expr(name: str) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant column."""
    x, n = num_sql(name), f"cast(count({num_sql(name)}) AS double)"
    return F.expr(
        f"CASE WHEN {n} < 3 THEN NULL WHEN stddev_pop({x}) = 0 THEN 0D ELSE skewness({x}) * sqrt({n} * ({n} - 1)) / ({n} - 2) END"
    )


def corr_sql(x: str, y: str) -> str:
    """Pearson correlation of the rows holding both; null where either side is constant (``corr`` would divide by 0)."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))"


def _distinct_key(df: DataFrame, name: str) -> str:
    """A short text that is equal exactly where the values are; long strings go as their md5."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return f"CASE WHEN octet_length({ref(name)}) > 32 THEN md5({ref(name)}) ELSE {ref(name)} END"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"cast({num_sql(name)} + 0D AS string)"
    if isinstance(dtype, T.BinaryType):
        return f"md5({ref(name)})"
    return f"cast({ref(name)} AS string)"


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, int]:
    """Distinct non-null values per column.

    Exact counts of several columns shuffle (column, value) pairs, combined per
    task first; ``count_distinct`` would expand every row once per column with
    all columns as its key.
    """
    if not exact:
        return one_row(df, {c: F.approx_count_distinct(col(c), SKETCH_ERROR) for c in cols})
    if not cols:
        return {}
    cells = ", ".join(f"named_struct('c', {i}, 'v', {_distinct_key(df, c)})" for i, c in enumerate(cols))
    pairs = df.select(F.expr(f"inline(array({cells}))")).where("v IS NOT NULL").distinct()
    found = {r["c"]: r["count"] for r in pairs.groupBy("c").count().collect()}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


def decided_distinct_counts(
    df: DataFrame, marks: dict[str, list[float]] | None = None, cols: list[str] | None = None, estimates: dict[str, int] | None = None,
) -> dict[str, int]:
    """Distinct counts good enough for rules that compare them with the given marks; all exact without marks.

    One sketch pass for all columns (unless the caller has estimates). Columns with few values are then counted
    exactly by a set per task, and of the rest only those whose estimate lies near
    one of their marks by a shuffle of their distinct values.
    """
    cols = list(marks) if marks is not None else list(cols or [])
    if not cols:
        return {}
    counts = distinct_counts(df, cols, exact=False) if estimates is None else dict(estimates)
    few = [c for c in cols if counts[c] <= FEW_VALUES]
    near = [c for c in cols if c not in few and (marks is None or any(abs(counts[c] - m) <= 4 * SKETCH_ERROR * m for m in marks[c]))]
    counts.update(one_row(df, {c: F.size(F.collect_set(col(c))) for c in few}))
    counts.update(distinct_counts(df, near) if near else {})
    return counts


def gramian(df: DataFrame, cols: list[str], shift: dict[str, float] | None = None) -> np.ndarray:
    """Sum of x xᵀ over the rows (nulls as 0 after the shift), d x d on the driver.

    Narrow matrices are d(d+1)/2 SQL sums in one aggregation; wide ones take one
    partial matrix per Arrow batch inside the tasks and a grouped sum.
    """
    shift = shift or {}
    d = len(cols)
    xs = [f"coalesce({num_sql(c)} - {real(shift.get(c, 0.0))}, 0D)" for c in cols]
    g = np.zeros((d, d))
    if d <= 32:
        got = one_row(df, {(i, j): F.expr(f"sum({xs[i]} * {xs[j]})") for i in range(d) for j in range(i, d)})
        for (i, j), v in got.items():
            g[i, j] = g[j, i] = v or 0.0
        return g

    def partials(batches):
        import pandas as pd

        acc = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            acc += x.T @ x
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j, "v": acc[i, j]})

    parts = df.select(*[F.expr(x).alias(f"x{k}") for k, x in enumerate(xs)]).mapInPandas(partials, "i int, j int, v double")
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return g
