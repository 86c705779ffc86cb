"""Exact nearest neighbours of vectors inside each of a few groups, in two bounded rounds.

Equal vectors are merged first, so a vector repeated by a third of the rows is
one point with a weight. A k-d tree over a small hash-chosen subset cuts space
into leaves. Round one searches each point's own leaf and gives a radius; round
two visits only leaves whose bounding box reaches into that radius. The subset
decides balance only: the result is exact for any tree.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.session import materialize

# tasks carry this module's code with them: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_POINTS = 1_000
#: vectors that shape the tree of one group, at most
TREE_SAMPLE = 50_000
#: query points that one visit of a leaf handles
VISIT_POINTS = 50_000
#: points of a large group that one task handles beside the group's tree or boxes
PART_POINTS = 250_000
_BLOCK = 256

_CANDIDATES = "array<struct<dist:double,vec:array<double>,n:bigint>>"


class _Tree:
    """Splits as flat arrays: node i tests x[dim[i]] < cut[i], children 2i+1 and 2i+2; negative dim = leaf."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.dim = np.full(2 ** (depth + 1) - 1, -1, dtype=np.int64)
        self.cut = np.zeros(2 ** (depth + 1) - 1)
        stack = [(0, sample, 0)]
        while stack:
            node, pts, level = stack.pop()
            if level == depth or len(pts) < 2:
                continue
            d = int(np.argmax(pts.max(axis=0) - pts.min(axis=0)))
            cut = float(np.median(pts[:, d]))
            left = pts[:, d] < cut
            if not left.any() or left.all():
                cut = float(pts[:, d].max())
                left = pts[:, d] < cut
                if not left.any():
                    continue
            self.dim[node], self.cut[node] = d, cut
            stack += [(2 * node + 1, pts[left], level + 1), (2 * node + 2, pts[~left], level + 1)]


def _leaf(dim: np.ndarray, cut: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Leaf of each row of ``x``."""
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        d = dim[node]
        go = d >= 0
        if not go.any():
            return node
        right = x[np.arange(len(x)), np.maximum(d, 0)] >= cut[node]
        node = np.where(go, 2 * node + 1 + right, node)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _nearest(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, k: int, same_leaf: bool) -> list[list[dict]]:
    """k nearest points per query (by weight), ordered by distance then vector."""
    out: list[list[dict]] = []
    order_key = np.lexsort(points.T[::-1]) if len(points) else np.zeros(0, dtype=int)
    points, weights = points[order_key], weights[order_key]
    # rows of (queries x points) handled at once stay within a few million cells
    step = max(1, min(_BLOCK, 4_000_000 // max(1, points.size)))
    for s in range(0, len(queries), step):
        q = queries[s:s + step]
        d2 = ((q[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        take = min(k + 1, len(points))
        kth = np.partition(d2, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(q))
        # everything up to the k-th distance, ties included, so that ties are broken by vector
        row, at = np.nonzero(d2 <= kth[:, None])
        dist, n = d2[row, at], weights[at].astype(np.int64)
        if same_leaf:
            n = n - ((dist == 0.0) & (q[row] == points[at]).all(axis=1))
        order = np.lexsort((at, dist, row))
        order = order[n[order] > 0]
        row, at, dist, n = row[order], at[order], dist[order], n[order]
        first = np.searchsorted(row, np.arange(len(q) + 1))
        before = np.concatenate(([0], np.cumsum(n)))
        kept = before[:-1] - before[first[row]] < k
        cells = [{"dist": a, "vec": b, "n": c} for a, b, c in zip(dist[kept].tolist(), points[at[kept]].tolist(), n[kept].tolist(), strict=True)]
        ends = np.searchsorted(row[kept], np.arange(len(q) + 1)).tolist()
        out += [cells[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def nearest_vectors(
    points: DataFrame, k: int = 5, leaf_points: int | None = None, part_points: int | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """(g, vec, n, neighbours): for each distinct vector its k nearest rows' vectors in the same group.

    ``points(g, vec array<double>)`` has a row per point, ``g`` of any type that can be grouped; rows without a group are
    left out. A vector is listed once per row that holds it. A point is not its own neighbour; its duplicates are. Every
    group has its own tree, as deep as its size asks for. Trees and leaf boxes are tables: a task reads those of one group
    beside at most ``part_points`` of its points, and none reach the driver. With ``wanted(g, vec)``, vectors among the points,
    only these are searched for (and listed), among all points.
    """
    leaf_points, part_points = leaf_points or LEAF_POINTS, part_points or PART_POINTS
    g_type = points.schema["g"].dataType.simpleString()
    marked = points.where("g IS NOT NULL").select("g", "vec", F.lit(1).cast("bigint").alias("n"), F.lit(wanted is None).alias("asked"))
    if wanted is not None:
        marked = marked.unionByName(wanted.where("g IS NOT NULL").select("g", "vec", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")))
    distinct = materialize(marked.groupBy("g", "vec").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")), "vectors")
    # only groups beyond one leaf need a tree; they are handled in parts
    sizes = distinct.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > leaf_points)
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("m") / part_points).cast("int")), "vector-groups")
    parts = lambda: sizes.select(F.col("g").alias("g"), F.col("parts").alias("parts"))  # noqa: E731 - joined more than once
    each_part = lambda table: table.join(parts(), "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tagged = distinct.withColumns({"leaf": F.lit(0).cast("bigint"), "parts": F.lit(0)})
    split = not sizes.isEmpty()
    fresh = lambda table: table.select(*[F.col(c).alias(c) for c in table.columns])  # noqa: E731 - tables that meet themselves
    if split:
        tagged = materialize(distinct.join(parts(), "g", "left_anti").withColumns({"leaf": F.lit(0).cast("bigint"), "parts": F.lit(0)}).unionByName(
            _tag(fresh(distinct).join(parts(), "g"), each_part(_trees(fresh(distinct), fresh(sizes), leaf_points, g_type)), g_type)), "leaves")

    def own_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = _matrix(pdf["vec"]), pdf["n"].to_numpy()
        asked = pdf["asked"].to_numpy(dtype=bool)
        if not asked.any():
            return pd.DataFrame()
        found, pdf = _nearest(x[asked], x, w, k, True), pdf[asked].drop(columns="asked")
        radius = [f[-1]["dist"] if sum(c["n"] for c in f) >= k else np.inf for f in found]
        return pdf.assign(found=found, radius=radius)

    first = materialize(
        tagged.groupBy("g", "leaf").applyInPandas(
            own_leaf, f"g {g_type}, vec array<double>, n bigint, leaf bigint, parts int, found {_CANDIDATES}, radius double"
        ),
        "near",
    )
    found = first.select("g", "vec", "found")
    if split:
        large = fresh(tagged).where("parts > 0")
        boxes = materialize(large.groupBy("g", "leaf").applyInPandas(_box, f"g {g_type}, leaf bigint, lo array<double>, hi array<double>"), "leaf-boxes")
        near = fresh(first).where("parts > 0").select("g", "vec", "leaf", "radius", F.expr("cast(pmod(leaf, parts) AS int)").alias("part"))
        asked = near.groupBy("g", "part").cogroup(each_part(boxes).groupBy("g", "part")).applyInPandas(_reach, f"g {g_type}, vec array<double>, leaf bigint")
        found = found.unionByName(_visit(materialize(asked, "asked"), large, k, g_type))
    merged = found.groupBy("g", "vec").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    repeated = F.slice(F.flatten(F.transform("found", lambda c: F.array_repeat(c["vec"], F.least(c["n"], F.lit(k)).cast("int")))), 1, k)
    return first.select("g", "vec", "n").join(merged, ["g", "vec"]).select("g", "vec", "n", repeated.alias("neighbours"))


def _trees(distinct: DataFrame, sizes: DataFrame, leaf_points: int, g_type: str) -> DataFrame:
    """(g, dim, cut): a tree per large group, each built by one task from at most about ``TREE_SAMPLE`` of its vectors."""
    share = F.least(F.lit(1.0), F.lit(float(TREE_SAMPLE)) / F.col("m"), F.lit(32.0 / leaf_points))
    sample = distinct.join(sizes, "g").where(F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) / 1_000_003 < share).select("g", "vec", "m")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = min(int(np.ceil(np.log2(pdf["m"].iloc[0] / leaf_points))), int(np.ceil(np.log2(len(pdf)))) + 1)
        tree = _Tree(_matrix(pdf["vec"]), depth)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "dim": [tree.dim], "cut": [tree.cut]})

    return materialize(sample.groupBy("g").applyInPandas(grow, f"g {g_type}, dim array<bigint>, cut array<double>"), "trees")


def _tag(points: DataFrame, trees: DataFrame, g_type: str) -> DataFrame:
    """Points of large groups with their leaf; leaf 0 where a group has no tree."""
    def tag(held: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        leaf = _leaf(tree["dim"].iloc[0], tree["cut"].iloc[0], _matrix(held["vec"])) if len(tree) else 0
        return held[["g", "vec", "n", "asked"]].assign(leaf=leaf, parts=held["parts"])

    points = points.withColumn("part", F.expr("cast(pmod(xxhash64(vec), parts) AS int)"))
    return points.groupBy("g", "part").cogroup(trees.groupBy("g", "part")).applyInPandas(
        tag, f"g {g_type}, vec array<double>, n bigint, asked boolean, leaf bigint, parts int")


def _box(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf["vec"])
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "leaf": [pdf["leaf"].iloc[0]], "lo": [x.min(axis=0)], "hi": [x.max(axis=0)]})


def _reach(near: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """(g, vec, leaf): other leaves whose box reaches into the radius of a point, whole leaves of points being ruled out first."""
    out = []
    if len(near):
        leaves, los, his = boxes["leaf"].to_numpy(), _matrix(boxes["lo"]), _matrix(boxes["hi"])
        for me, pdf in near.groupby("leaf"):
            x, radius = _matrix(pdf["vec"]), pdf["radius"].to_numpy()
            gap = np.maximum(0, np.maximum(los - x.max(axis=0), x.min(axis=0) - his))
            some = np.flatnonzero(((gap**2).sum(axis=1) <= radius.max()) & (leaves != me))
            step = max(1, 4_000_000 // max(1, len(some) * x.shape[1]))
            for s in range(0, len(x), step):
                at = x[s:s + step, None, :]
                apart = np.maximum(0, np.maximum(los[some] - at, at - his[some]))
                i, j = np.nonzero((apart**2).sum(axis=2) <= radius[s:s + step, None])
                out.append(pd.DataFrame({"g": pdf["g"].iloc[0], "vec": pdf["vec"].to_numpy()[s + i], "leaf": leaves[some[j]]}))
    return pd.concat(out) if out else pd.DataFrame()


def _visit(asked: DataFrame, tagged: DataFrame, k: int, g_type: str) -> DataFrame:
    """(g, vec, found): what the asked leaves hold, each leaf serving at most about ``VISIT_POINTS`` points a task."""
    load = materialize(asked.groupBy("g", "leaf").agg(F.ceil(F.count("*") / VISIT_POINTS).cast("int").alias("chunks")), "visits")
    fresh = lambda: load.select(*[F.col(c).alias(c) for c in load.columns])  # noqa: E731 - the two sides meet again below
    asked = asked.join(fresh(), ["g", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int"))
    serving = tagged.select(*[F.col(c).alias(c) for c in tagged.columns]).join(fresh(), ["g", "leaf"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def visit(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame()
        got = _nearest(_matrix(queries["vec"]), _matrix(held["vec"]), held["n"].to_numpy(), k, False)
        return pd.DataFrame({"g": queries["g"], "vec": queries["vec"], "found": got})

    return asked.groupBy("g", "leaf", "chunk").cogroup(serving.groupBy("g", "leaf", "chunk")).applyInPandas(
        visit, f"g {g_type}, vec array<double>, found {_CANDIDATES}",
    )
