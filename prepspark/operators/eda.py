"""Distributions, association and quality figures as tidy tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import (
    col, is_missing, kinds, num, num_sql, numeric_columns, one_row, real, stack_rows, string_columns,
)
from prepspark.functions.ranks import key_hash
from prepspark.functions.lookups import BROADCAST_ROWS
from prepspark.functions.stats import corr_sql, distinct_counts, gramian, quantiles, skew_expr
from prepspark.operators import profile as P
from prepspark.operators import reduce as R
from prepspark.session import side_by_side


def _tall(df: DataFrame, cols: list[str], value, extra: list[Column] = ()) -> DataFrame:
    """One row per (row, column) with ``column`` and ``value``; aggregated right after, map-side."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in cols])
    return df.select(*extra, F.explode(cells).alias("r")).select(*(["extra"] if extra else []), "r.*")


def value_counts(df: DataFrame, cols: list[str] | None = None, max_distinct: int | None = None) -> DataFrame:
    """(column, value, n) of categorical columns, nulls left out; wide ones skipped if ``max_distinct`` is set."""
    cols = string_columns(df) if cols is None else cols
    if max_distinct is not None and cols:
        nd = distinct_counts(df, cols)
        cols = [c for c in cols if nd[c] <= max_distinct]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    tall = _tall(df, cols, lambda c: col(c).cast("string")).where(F.col("value").isNotNull())
    return tall.groupBy("column", "value").agg(F.count("*").alias("n"))


def target_distribution(df: DataFrame, target: str, imbalance: float = 0.2) -> DataFrame:
    """(class, n, share, imbalanced): flagged if the smallest share is below the bound."""
    sizes = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    whole = one_row(sizes, {"n": F.sum("n"), "least": F.min("n")})
    n = whole["n"] or 1
    flag = (whole["least"] or n) / n < imbalance
    return sizes.select("class", "n", (F.col("n") / F.lit(float(n))).alias("share"), F.lit(flag).alias("imbalanced"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Class counts of a target that is no number or has up to 10 values, else mean and standard deviation: (item, value)."""
    if kinds(df)[target] != "numeric" or distinct_counts(df, [target])[target] <= 10:
        sizes = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("g")).agg(F.count("*").alias("n"))
        return sizes.select(F.concat(F.lit("class:"), "g").alias("item"), F.col("n").cast("double").alias("value"))
    got = one_row(df, {"mean": F.avg(num(target)), "std": F.stddev(num(target))})
    return df.sparkSession.createDataFrame(list(got.items()), "item string, value double")


def _ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    got = one_row(df, {(f, c): a(num(c)) for c in cols for f, a in (("lo", F.min), ("hi", F.max))})
    return {c: (got[("lo", c)], got[("hi", c)]) for c in cols if got[("lo", c)] is not None}


def auto_bins(df: DataFrame, cols: list[str], ranges: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Bin count from the narrower of the Sturges and Freedman-Diaconis widths."""
    counts = one_row(df, {c: F.count(num(c)) for c in ranges})
    quart = quantiles(df, {c: [0.25, 0.75] for c in ranges})
    out = {}
    for c, (lo, hi) in ranges.items():
        span = hi - lo
        sturges = span / (math.log2(counts[c]) + 1)
        fd = 2 * (quart[c][1] - quart[c][0]) / counts[c] ** (1 / 3)
        width = min(fd, sturges) if fd else sturges
        out[c] = max(1, math.ceil(span / width)) if width else 1
    return out


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int | str = 30, empty: bool = True) -> DataFrame:
    """(column, bin, lo, hi, n): equal-width bins, the last one closed.

    Empty bins come from a distributed range; ``empty=False`` leaves them out, so that the table has no more rows
    than there are values however many bins an outlier asks for.
    """
    cols = numeric_columns(df) if cols is None else cols
    ranges = _ranges(df, cols)
    per_col = auto_bins(df, cols, ranges) if bins == "auto" else {c: int(bins) for c in ranges}
    # a constant column spans half a unit to either side
    ranges = {c: (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5) for c, (lo, hi) in ranges.items()}

    def bucket(c: str) -> Column:
        lo, hi = ranges[c]
        x, k = num(c), per_col[c]
        return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * k).cast("long") + 1, F.lit(k).cast("long"))

    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], "column string, bin long, lo double, hi double, n long")
    tall = _tall(df, list(ranges), bucket).where(F.col("value").isNotNull())
    out = tall.groupBy("column", F.col("value").alias("bin")).agg(F.count("*").alias("n"))
    if empty:
        grid = None
        for c in ranges:
            one = spark.range(1, per_col[c] + 1).select(F.lit(c).alias("column"), F.col("id").alias("bin"))
            grid = one if grid is None else grid.unionByName(one)
        out = grid.join(out, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_column = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("column"))
    first, width = per_column({c: lo for c, (lo, _) in ranges.items()}), per_column({c: (hi - lo) / per_col[c] for c, (lo, hi) in ranges.items()})
    return out.select("column", "bin", (first + (F.col("bin") - 1) * width).alias("lo"), (first + F.col("bin") * width).alias("hi"), "n")


def box_stats(df: DataFrame, cols: list[str] | None = None, exact: bool = True, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR of the box) and outlier count per column."""
    cols = numeric_columns(df) if cols is None else cols
    qs = quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}, exact)
    cols = [c for c in cols if qs[c][0] is not None]
    exprs: dict[str, dict[str, Column]] = {}
    for c in cols:
        q1, q2, q3 = (float(v) for v in qs[c])
        lo, hi, x = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1), num(c)
        exprs[c] = {
            "q1": F.max(F.lit(q1)), "median": F.max(F.lit(q2)), "q3": F.max(F.lit(q3)),
            "whisker_low": F.min(F.when(x >= lo, x)), "whisker_high": F.max(F.when(x <= hi, x)),
            "outliers": F.count_if((x < lo) | (x > hi)),
        }
    return stack_rows(df, exprs)


#: Terms of the Hermite series of a box and bandwidths beyond which a box is left out; together they bound the error of ``density``.
HERMITE_TERMS, REACH = 16, 8.0


def density_error(terms: int = HERMITE_TERMS, reach: float = REACH) -> float:
    """Bound of the error of ``density``, as a share of the kernel's largest value.

    Boxes are one bandwidth wide, so a value lies within r = 1 / (2 sqrt 2) of its centre in units of sqrt 2 bandwidths. By Cramer's
    bound on Hermite functions term n is at most 1.09 (sqrt 2 r)^n / sqrt(n!), and sqrt 2 r = 1/2.
    """
    return 1.09 * 0.5**terms / math.sqrt(math.factorial(terms)) * 2 + math.exp(-((reach - 0.5) ** 2) / 2)


def density(df: DataFrame, cols: list[str] | None = None, points: int = 50, terms: int = HERMITE_TERMS, reach: float = REACH) -> DataFrame:
    """(column, x, density): Gaussian kernel estimate with Scott's bandwidth at evenly spaced points, cut three bandwidths beyond the values.

    A fast Gauss transform: the values of a box one bandwidth wide become the first moments about its centre, in one aggregation,
    and a point near the box sums its Hermite series. Boxes follow from the bandwidth, no number of bins is chosen. The result is the
    exact sum within ``density_error`` times the kernel's peak. Columns without two different values are left out.
    """
    cols = numeric_columns(df) if cols is None else cols
    got = one_row(df, {(f, c): a(num(c)) for c in cols for f, a in (("n", F.count), ("s", F.stddev), ("lo", F.min), ("hi", F.max))})
    cols = [c for c in cols if got[("s", c)]]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, x double, density double")
    specs = []
    for c in cols:
        h = got[("s", c)] * got[("n", c)] ** -0.2
        x0 = got[("lo", c)] - 3 * h
        specs.append((c, h, got[("lo", c)], x0, (got[("hi", c)] + 3 * h - x0) / (points - 1), got[("n", c)]))
    value = ", ".join(
        f"named_struct('i', {i}, 'bw', {real(h)}, 'lo', {real(lo)}, 'x0', {real(x0)}, 'step', {real(step)}, 'total', {real(n)}, 'y', {num_sql(c)})"
        for i, (c, h, lo, x0, step, n) in enumerate(specs))
    tall = df.select(F.explode(F.expr(f"array({value})")).alias("v")).select("v.*").where("y IS NOT NULL")
    keys = ["i", "bw", "lo", "x0", "step", "total"]
    placed = tall.selectExpr("*", "floor((y - lo) / bw) AS box").selectExpr(*keys, "box", "(y - (lo + (box + 0.5D) * bw)) / (bw * sqrt(2D)) AS t")
    boxes = placed.groupBy(*keys, "box").agg(*[F.expr(f"sum(pow(t, {k}D)) / {real(math.factorial(k))}").alias(f"m{k}") for k in range(terms)])
    near = boxes.selectExpr(
        *keys, "lo + (box + 0.5D) * bw AS center", f"array({', '.join(f'm{k}' for k in range(terms))}) AS m",
    ).selectExpr(
        "*", f"CAST(greatest(0, ceil((center - {real(reach)} * bw - x0) / step)) AS INT) AS first", f"CAST(least({points - 1}, floor((center + {real(reach)} * bw - x0) / step)) AS INT) AS last",
    ).where("first <= last").withColumn("j", F.explode(F.sequence("first", "last")))
    series = """aggregate(m, named_struct('k', 0D, 'a', 0D, 'b', exp(-z * z), 's', 0D),
        (acc, v) -> named_struct('k', acc.k + 1D, 'a', acc.b, 'b', 2D * z * acc.b - 2D * acc.k * acc.a, 's', acc.s + v * acc.b), acc -> acc.s)"""
    summed = near.selectExpr("i", "j", "total * bw AS scale", "m", "(x0 + step * j - center) / (bw * sqrt(2D)) AS z").selectExpr(
        "i", "j", "scale", f"{series} AS part")
    found = summed.groupBy("i", "j").agg((F.sum("part") / F.max("scale") / math.sqrt(2 * math.pi)).alias("d"))
    grid = df.sparkSession.createDataFrame([(i, s[0], float(s[3]), float(s[4])) for i, s in enumerate(specs)], "i int, column string, x0 double, step double")
    grid = grid.select("i", "column", "x0", "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    return grid.join(found, ["i", "j"], "left").select("column", (F.col("x0") + F.col("step") * F.col("j")).alias("x"), F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(0.0)).alias("density"))


def corr_matrix(df: DataFrame, cols: list[str] | None = None, only_varying: bool = False, batch: int = 435, few_pairs: int = 15) -> DataFrame:
    """(a, b, r) for all pairs of numeric columns in both orders, rows with either missing left out.

    A few pairs share one aggregation of correlations. With more, columns without
    missing cells take theirs from one matrix of centred products, and only the
    pairs left over are correlated one by one, up to ``batch`` per aggregation.
    """
    cols = numeric_columns(df) if cols is None else cols
    stats = one_row(df, {(f, c): a for c in cols for f, a in (("s", F.stddev_pop(num(c))), ("m", F.avg(num(c))), ("z", F.count_if(num(c).isNull())))})
    if only_varying:
        cols = [c for c in cols if stats[("s", c)]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    plain = {c for c in cols if stats[("s", c)] and not stats[("z", c)]}
    pair = lambda a, b: F.expr(f"corr({num_sql(a)}, {num_sql(b)})" if a in plain and b in plain else corr_sql(num_sql(a), num_sql(b)))
    r: dict[tuple[str, str], float | None] = {}
    whole = [c for c in cols if not stats[("z", c)]]
    if len(pairs) > few_pairs and len(whole) > 1:
        g = gramian(df, whole, {c: stats[("m", c)] for c in whole})
        d = np.sqrt(np.diag(g))
        for i, a in enumerate(whole):
            for j in range(i + 1, len(whole)):
                den = d[i] * d[j] if a in plain and whole[j] in plain else 0.0
                r[(a, whole[j])] = float(g[i, j] / den) if den else None
    left = [p for p in pairs if p not in r]
    for i in range(0, len(left), batch):
        r.update(one_row(df, {p: pair(*p) for p in left[i:i + batch]}))
    rows = [(a, a, 1.0 if stats[("s", a)] else None) for a in cols]
    rows += [(x, y, None if v is None or math.isnan(v) else v) for (a, b), v in r.items() for x, y in ((a, b), (b, a))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def high_corr_pairs(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.8, k: int | None = None) -> DataFrame:
    """Pairs (in column order) with |r| above the threshold; the first k if asked for."""
    cols = numeric_columns(df) if cols is None else cols
    at = {c: i for i, c in enumerate(cols)}
    rows = corr_matrix(df, cols, only_varying=True).where(F.abs("r") > threshold).collect()
    upper = sorted((at[x["a"]], at[x["b"]], x["r"]) for x in rows if at[x["a"]] < at[x["b"]])
    found = [(cols[i], cols[j], r) for i, j, r in upper[:k]]
    return df.sparkSession.createDataFrame(found, "a string, b string, r double")


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = acc = 1.0 / a
        k = a
        while abs(term) > abs(acc) * 1e-16:
            k += 1
            term *= x / k
            acc += term
        return max(0.0, 1.0 - acc * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi_square(df: DataFrame, target: str, cols: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """(column, chi2, dof, p_value) of every categorical column against the target; Yates for 2 x 2.

    Only observed cells exist as rows. An empty cell contributes its expected
    count, and those sum to the total less the expected counts of the observed
    cells, so the full cross table is never built.
    """
    cols = string_columns(df, [target]) if cols is None else cols
    known = df.where(col(target).isNotNull())
    tall = _tall(known, cols, lambda c: col(c).cast("string"), [col(target).cast("string").alias("extra")])
    cells = tall.where(F.col("value").isNotNull()).groupBy("column", "value", "extra").agg(F.count("*").alias("o"))
    by_value = cells.groupBy("column", "value").agg(F.sum("o").alias("r"))
    # one row per column and class: measured, then broadcast; a class that holds half of all cells would be a hot join key
    by_class = cells.groupBy("column", "extra").agg(F.sum("o").alias("c"))
    few = by_class.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = by_value.groupBy("column").agg(F.count("*").alias("nr"), F.sum(1 / F.col("r")).alias("ir"), F.sum("r").alias("n"))
    classes = by_class.groupBy("column").agg(F.count("*").alias("nc"), F.sum(1 / F.col("c")).alias("ic"))
    totals = rows.join(classes, "column")
    e = F.col("r") * F.col("c") / F.col("n")
    full = cells.join(by_value, ["column", "value"]).join(F.broadcast(by_class) if few else by_class, ["column", "extra"]).join(F.broadcast(totals), "column")
    full = full.withColumn("e", e)
    summed = full.groupBy("column").agg(
        F.count("*").alias("seen"), F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("q"),
        F.sum("e").alias("se"), F.max(F.abs(F.col("o") - F.col("e"))).alias("d"),
        *[F.max(x).alias(x) for x in ("nr", "nc", "ir", "ic", "n")],
    )
    dof = ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("long")
    empty = F.when(F.col("seen") == F.col("nr") * F.col("nc"), F.lit(0.0)).otherwise(F.col("n") - F.col("se"))
    kept = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    yates = kept * kept * F.col("n") * F.col("ir") * F.col("ic")
    chi2 = F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(F.col("q") + empty)
    table = summed.select("column", chi2.alias("chi2"), dof.alias("dof"))
    if not with_p:
        return table
    out = [(r["column"], r["chi2"], r["dof"], gamma_tail(r["dof"] / 2, r["chi2"] / 2) if r["dof"] else 1.0) for r in table.collect()]
    return df.sparkSession.createDataFrame(out, "column string, chi2 double, dof long, p_value double")


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, skew): bias-corrected, one aggregation."""
    cols = numeric_columns(df) if cols is None else cols
    return stack_rows(df, {c: {"skew": skew_expr(c)} for c in cols})


def vif(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, vif) without intercept, over columns that have no missing cell."""
    cols = numeric_columns(df) if cols is None else cols
    gaps = one_row(df, {c: F.count_if(num(c).isNull()) for c in cols})
    cols = [c for c in cols if not gaps[c]]
    g = gramian(df, cols)
    # unit diagonal first: the factors do not depend on the columns' units
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    unit = g / np.outer(scale, scale)
    try:
        inv = np.linalg.inv(unit)
        values = [float(inv[i, i] * unit[i, i]) for i in range(len(cols))]
    except np.linalg.LinAlgError:
        values = [math.inf] * len(cols)
    return df.sparkSession.createDataFrame(list(zip(cols, values)), "column string, vif double")


def pair_sample(df: DataFrame, cols: list[str] | None = None, hue: str | None = None, keys: list[str] | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    """Numeric columns (and a colouring column) for a pair plot: all columns and rows unless a list or a share is given."""
    cols = numeric_columns(df, [hue] if hue else []) if cols is None else cols
    out = df
    if share is not None:
        cut = format(int(share * 16**8), "08x") if share < 1 else "g"
        out = df.where(key_hash(keys, seed) < F.lit(cut))
    return out.select(*[col(c) for c in cols], *([col(hue)] if hue else []))


def missing_map(df: DataFrame, keys: list[str], digits: int = 1, cols: list[str] | None = None) -> DataFrame:
    """(block, column, rate): share of missing cells per block of rows (leading hash digits of the key)."""
    cols = [c for c in df.columns if c not in keys] if cols is None else cols
    block = F.substring(key_hash(keys), 1, digits)
    per_block = df.groupBy(block.alias("block")).agg(*[F.avg(is_missing(df, c).cast("double")).alias(f"r{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rate")) for i, c in enumerate(cols)])
    return per_block.select("block", F.explode(cells).alias("r")).select("block", "r.*")


def univariate_columns(df: DataFrame) -> DataFrame:
    """(column, group, n): the columns that the numeric and the categorical views show, with their filled cells."""
    names = {"numeric": "numeric", "string": "categorical"}
    return stack_rows(df, {c: {"group": F.max(F.lit(names[k])), "n": F.count_if(~is_missing(df, c))} for c, k in kinds(df).items() if k in names})


def _section(df: DataFrame, section: str, label: Column, metric: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), label.alias("column"), metric.cast("string").alias("metric"), value.cast("double").alias("value"),
    )


def eda_report(df: DataFrame, target: str | None = None, importance_trees: int = 20, max_distinct: int | None = None) -> DataFrame:
    """(section, column, metric, value): all figures in one tidy table.

    Sections: overview, missing, value_counts (of all values, or of columns with up to ``max_distinct``), box, skew,
    corr, vif and, with a target, target, chi_square and importance (left out with ``importance_trees=0``).
    """
    numeric, c = numeric_columns(df), F.col
    build: dict = {
        "overview": lambda: [_section(P.profile_overview(df), "overview", F.lit(None).cast("string"), c("item"), c("value"))],
        "missing": lambda: [_section(P.profile_missing(df), "missing", c("column"), F.lit("missing"), c("missing"))],
        "value_counts": lambda: [_section(value_counts(df, max_distinct=max_distinct), "value_counts", c("column"), c("value"), c("n"))],
    }
    if numeric:
        build["box"] = lambda: _box_sections(df, numeric)
        build["skew"] = lambda: [_section(skewness(df, numeric), "skew", c("column"), F.lit("skew"), c("skew"))]
        build["corr"] = lambda: [_section(corr_matrix(df, numeric), "corr", c("a"), c("b"), c("r"))]
        build["vif"] = lambda: [_section(vif(df, numeric), "vif", c("column"), F.lit("vif"), c("vif"))]
    if target is not None:
        build["target"] = lambda: _target_sections(df, target)
        if string_columns(df, [target]):
            build["chi_square"] = lambda: [_section(chi_square(df, target), "chi_square", c("column"), F.lit("chi2"), c("chi2"))]
        if importance_trees:
            build["importance"] = lambda: [
                _section(R.rf_importance(df, target, importance_trees), "importance", c("feature"), F.lit("importance"), c("importance"))
            ]
    parts = [p for section in side_by_side(df.sparkSession, build).values() for p in section]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _box_sections(df: DataFrame, cols: list[str]) -> list[DataFrame]:
    marks = ("q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in marks])).alias("r")
    tall = box_stats(df, cols).select("column", cells).select("column", "r.*")
    return [_section(tall, "box", F.col("column"), F.col("metric"), F.col("v"))]


def _target_sections(df: DataFrame, target: str) -> list[DataFrame]:
    dist = target_distribution(df, target)
    flag = F.col("imbalanced").cast("int")
    return [
        _section(dist, "target", F.lit(target), F.col("class"), F.col("share")),
        _section(dist.limit(1), "target_imbalanced", F.lit(target), F.lit("imbalanced"), flag),
    ]
