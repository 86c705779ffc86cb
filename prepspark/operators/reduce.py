"""Projections, clusters and model-based importances of numeric columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prepspark.functions import wide
from prepspark.functions.clusters import fit_kmeans
from prepspark.functions.columns import col, kinds, num, num_sql, numeric_columns, one_row, real, ref
from prepspark.functions.stats import distinct_counts, gramian
from prepspark.operators.clean import impute_median
from prepspark.operators.encode import attach, category, encode_label, fit_categories
from prepspark.operators.scale import apply_scale, fit_scale


#: Columns beyond which the d x d products are not built.
WIDE_COLUMNS = 512


@dataclass(frozen=True)
class Projection:
    """Column k of the result is the sum of (x - center) * weight[k] over the input columns."""

    cols: tuple[str, ...]
    center: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    explained: float
    method: str


def zero_fraction(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(cells, zeros, fraction, method): more than half zeros asks for SVD, else PCA."""
    cols = numeric_columns(df) if cols is None else cols
    zeros = F.expr("sum(" + " + ".join(f"coalesce(cast({ref(c)} = 0 AS bigint), 0)" for c in cols) + ")")
    row = df.agg((F.count("*") * len(cols)).alias("cells"), F.coalesce(zeros, F.lit(0)).alias("zeros"))
    fraction = F.when(F.col("cells") > 0, F.col("zeros") / F.col("cells")).otherwise(F.lit(0.0))
    return row.withColumn("fraction", fraction).withColumn("method", F.when(F.col("fraction") > 0.5, "SVD").otherwise("PCA"))


def _leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k largest eigenvalues and their vectors, each vector's largest loading positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return values[order], _oriented(vectors[:, order])


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Vectors with their largest loading positive."""
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def _fit_wide(df: DataFrame, cols: list[str], k: int, method: str) -> Projection:
    means, values, vectors, n, squares = wide.leading(df, cols, min(k, len(cols)), method == "PCA")
    vectors = _oriented(vectors)
    if method == "PCA":
        explained = float(values.sum() / squares) if squares else 0.0
        return Projection(tuple(cols), tuple(means.tolist()), tuple(map(tuple, vectors.T.tolist())), explained, "PCA")
    across = vectors.T @ means
    explained = float((values.sum() - n * (across @ across)) / squares) if squares else 0.0
    return Projection(tuple(cols), (0.0,) * len(cols), tuple(map(tuple, vectors.T.tolist())), explained, "SVD")


def fit_pca(df: DataFrame, cols: list[str], k: int, wide_columns: int = WIDE_COLUMNS) -> Projection:
    """Centred principal components from one pass for means and one for the d x d products; tables beyond ``wide_columns``
    numeric columns take passes over d x k blocks instead (``wide.leading``)."""
    if len(cols) > wide_columns:
        return _fit_wide(df, cols, k, "PCA")
    got = one_row(df, {"n": F.count("*"), **{("m", c): F.avg(num(c)) for c in cols}})
    means = {c: got[("m", c)] or 0.0 for c in cols}
    cov = gramian(df, cols, means) / max(1, got["n"] - 1)
    values, vectors = _leading(cov, k)
    trace = float(np.trace(cov))
    explained = float(values.sum() / trace) if trace else 0.0
    return Projection(tuple(cols), tuple(means[c] for c in cols), tuple(map(tuple, vectors.T.tolist())), explained, "PCA")


def fit_svd(df: DataFrame, cols: list[str], k: int, wide_columns: int = WIDE_COLUMNS) -> Projection:
    """Leading right singular vectors of the uncentred table; wide tables as in ``fit_pca``."""
    if len(cols) > wide_columns:
        return _fit_wide(df, cols, k, "SVD")
    got = one_row(df, {"n": F.count("*"), **{("m", c): F.avg(num(c)) for c in cols}})
    g = gramian(df, cols)
    _, vectors = _leading(g, k)
    n = max(1, got["n"])
    m = np.array([got[("m", c)] or 0.0 for c in cols])
    cov = g / n - np.outer(m, m)
    trace = float(np.trace(cov))
    explained = float(np.trace(vectors.T @ cov @ vectors) / trace) if trace else 0.0
    return Projection(tuple(cols), (0.0,) * len(cols), tuple(map(tuple, vectors.T.tolist())), explained, "SVD")


def apply_projection(df: DataFrame, p: Projection, prefix: str | None = None, keep_inputs: bool = False) -> DataFrame:
    """Weighted sums; above 16 columns over one array of centred values, which keeps the generated code small."""
    prefix = f"{p.method}_" if prefix is None else prefix
    kept = df.columns if keep_inputs else [c for c in df.columns if c not in p.cols]
    xs = [f"coalesce({num_sql(c)} - {real(m)}, 0D)" for c, m in zip(p.cols, p.center)]
    names = [f"{prefix}{i + 1}" for i in range(len(p.weights))]
    if len(xs) <= 16:
        sums = [" + ".join(f"{x} * {real(w)}" for x, w in zip(xs, ws)) for ws in p.weights]
        return df.select(*[col(c) for c in kept], *[F.expr(e).alias(n) for n, e in zip(names, sums)])
    arrays = df.select(*[col(c) for c in kept], F.expr(f"array({', '.join(xs)})").alias("__xs"))
    dots = [f"aggregate(zip_with(__xs, array({', '.join(real(w) for w in ws)}), (x, w) -> x * w), 0D, (a, v) -> a + v)" for ws in p.weights]
    return arrays.select(*[col(c) for c in kept], *[F.expr(e).alias(n) for n, e in zip(names, dots)])


def reduce_pca(df: DataFrame, k: int | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    """Numeric columns replaced by ``PCA_i``; target and other excluded columns stay."""
    cols = numeric_columns(df, exclude)
    return apply_projection(df, fit_pca(fit_on or df, cols, k or min(10, len(cols) // 2)))


def reduce_svd(df: DataFrame, k: int | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    """Numeric columns replaced by ``SVD_i``."""
    cols = numeric_columns(df, exclude)
    return apply_projection(df, fit_svd(fit_on or df, cols, k or min(10, len(cols) // 2)))


def dimensionality_reduction(df: DataFrame, target: str | None = None, k: int | None = None, min_columns: int = 5) -> DataFrame:
    """SVD for tables with mostly zeros, else PCA; untouched with fewer than five numeric columns."""
    exclude = [target] if target else []
    cols = numeric_columns(df, exclude)
    if len(cols) < min_columns:
        return df
    method = zero_fraction(df, cols).first()["method"]
    return (reduce_svd if method == "SVD" else reduce_pca)(df, k, exclude)


def standard_pca(df: DataFrame, cols: list[str], k: int = 3, prefix: str = "pca_") -> DataFrame:
    """First components of the standardised columns, added beside them."""
    s = fit_scale(df, "standard", cols)
    p = fit_pca(apply_scale(df, s), cols, min(k, len(cols)))
    scaled = Projection(
        p.cols, tuple(s.center[c] for c in cols), tuple(tuple(w / s.spread[c] for w, c in zip(ws, cols)) for ws in p.weights),
        p.explained, p.method,
    )
    return apply_projection(df, scaled, prefix, keep_inputs=True)


def fit_clusters(
    df: DataFrame, cols: list[str], ks: list[int], seed: int = 42, rounds: int = 20, starts: int = 4, first: list[list[float]] | None = None,
) -> dict[int, list[list[float]]]:
    """Sorted k-means centres per k, on columns that are already scaled; ``first`` gives the starting centres of its own length."""
    if not ks and not first:
        return {}
    points = df.select(F.array(*[F.coalesce(num(c), F.lit(0.0)) for c in cols]).alias("xs"))
    fits = fit_kmeans(points, [len(first)] if first else ks, seed, starts, rounds, **({} if first is None else {"first": np.array(first, dtype=float), "tol": 0.0}))
    return {k: f.centers.tolist() for k, f in fits.items()}


def cluster_features(df: DataFrame, cols: list[str] | None = None, max_clusters: int = 5, seed: int = 42, with_pca: bool = False) -> DataFrame:
    """``cluster_k{k}`` and ``cluster_k{k}_dist`` for k in 2, 3, 5 on the given (or all) standardised numeric columns.

    Needs three numeric columns. Centres are the best of several seeded starts, labels follow the sorted centres.
    Assignment is a column expression over the centres.
    """
    cols = numeric_columns(df) if cols is None else cols
    if len(cols) < 3:
        return df
    n = df.limit(max_clusters).count()
    ks = [k for k in (2, 3, 5) if k <= max_clusters and k <= n]
    s = fit_scale(df, "standard", cols)
    centers = fit_clusters(apply_scale(df, s), cols, ks, seed)
    scaled = {f"__s{i}": F.expr(f"coalesce(({num_sql(c)} - {real(s.center[c])}) / {real(s.spread[c])}, 0D)") for i, c in enumerate(cols)}
    square = lambda center: " + ".join(f"(__s{i} - {real(v)}) * (__s{i} - {real(v)})" for i, v in enumerate(center))
    added = {f"__d{k}": F.expr(f"array({', '.join(square(c) for c in centers[k])})") for k in ks}
    out = df.withColumns(scaled).withColumns(added)
    nearest = {k: F.array_min(F.col(f"__d{k}")) for k in ks}
    out = out.withColumns({
        **{f"cluster_k{k}": (F.array_position(F.col(f"__d{k}"), nearest[k]) - 1).cast("int") for k in ks},
        **{f"cluster_k{k}_dist": F.sqrt(nearest[k]) for k in ks},
    }).drop(*added, *scaled)
    return standard_pca(out, cols) if with_pca else out


def rf_importance(
    df: DataFrame, target: str, trees: int = 50, depth: int = 10, seed: int = 42, task: str = "auto", max_bins: int = 32,
) -> DataFrame:
    """(feature, importance) of a random forest; up to 20 target values mean classification.

    Rows without target are left out, text columns label-encoded, gaps filled
    with the median.
    """
    known = df.where(col(target).isNotNull())
    ks = kinds(known)
    features = [c for c in known.columns if c != target and ks[c] in ("numeric", "string", "boolean")]
    prepared = known.select(*[(col(c).cast("int").alias(c) if ks[c] == "boolean" else col(c)) for c in features], col(target))
    # all text columns are counted on the same rows in one pass, before any of them is replaced
    texts = [c for c in features if ks[c] == "string"]
    fits = fit_categories(known, texts)
    for c in texts:
        prepared = attach(prepared, category(c), fits[c]).withColumn(c, F.col("__code")).drop("__code", "__freq", "__stat")
    gaps = one_row(prepared, {c: F.count_if(num(c).isNull()) for c in features})
    holes = [c for c in features if gaps[c]]
    prepared = impute_median(prepared, holes) if holes else prepared
    classify = distinct_counts(known, [target])[target] <= 20 if task == "auto" else task == "classification"
    if classify:
        prepared = encode_label(prepared, target, "__y")
    else:
        prepared = prepared.withColumn("__y", num(target))
    inputs = prepared.select(*[num(c).alias(f"x{i}") for i, c in enumerate(features)], F.col("__y").cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(inputs)
    forest = (RandomForestClassifier if classify else RandomForestRegressor)(
        numTrees=trees, maxDepth=depth, seed=seed, maxBins=max_bins,
    )
    model = forest.fit(assembled.select("features", "label"))
    rows = list(zip(features, [float(v) for v in model.featureImportances.toArray()]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def cumulative_importance(importances: DataFrame, share: float = 0.8) -> DataFrame:
    """(rank, feature, importance, cumulative, needed): running sum, best first.

    ``needed`` marks the features up to and including the one that passes the
    share. The input is cut at some of its own values into runs; sums and counts of the runs
    before one start its own, so no window spans the table.
    """
    n = importances.count()
    parts = max(1, min(2000, n // 100))
    cuts = sorted({-v for v in importances.stat.approxQuantile("importance", [i / parts for i in range(1, parts)], 0.001)}) if parts > 1 else []
    run = F.size(F.filter(F.lit(cuts), lambda c: c <= -F.col("importance"))) if cuts else F.lit(0)
    placed = importances.select("feature", "importance", run.alias("run"))
    sizes = {r["run"]: (r["n"], r["s"]) for r in placed.groupBy("run").agg(F.count("*").alias("n"), F.sum("importance").alias("s")).collect()}
    ranks, sums = [0], [0.0]
    for i in range(len(cuts)):
        k, s = sizes.get(i, (0, 0.0))
        ranks.append(ranks[-1] + k)
        sums.append(sums[-1] + s)
    w = Window.partitionBy("run").orderBy(F.desc("importance"), "feature")
    before = F.coalesce(F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.element_at(F.lit(sums), F.col("run") + 1)
    ranked = placed.select((F.row_number().over(w) + F.element_at(F.lit(ranks), F.col("run") + 1)).cast("int").alias("rank"), "feature", "importance", before.alias("before"))
    return ranked.select("rank", "feature", "importance", (F.col("before") + F.col("importance")).alias("cumulative"), (F.col("before") <= share).alias("needed"))
