"""k-means by oversampled seeding and shared passes: all numbers of clusters and all starts go through the table together.

Draws are hashes of the points, so the centres do not depend on how rows are partitioned (up to the order of sums).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.session import materialize

# tasks carry this module's code with them: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED_ROUNDS = 2
#: rounds after which the best start of each k goes on alone
TRIAL_ROUNDS = 4
#: distances that a task holds at once
_CELLS = 500_000


@dataclass
class Fit:
    """Centres of one start, the sum of squared distances to them, and whether they still move."""

    k: int
    centers: np.ndarray
    inertia: float = np.inf
    moving: bool = True


def weighted_points(points: DataFrame) -> DataFrame:
    """(xs, w): each different vector of ``points(xs array<double>)`` and its rows, as a stage table. Null and -0.0 count as 0."""
    clean = F.transform("xs", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.coalesce(v, F.lit(0.0))))
    return materialize(points.select(clean.alias("xs")).groupBy("xs").agg(F.count("*").cast("double").alias("w")), "points")


def _blocks(batch: pa.RecordBatch, centers: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Vectors and further columns of a batch in blocks of bounded size."""
    rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    step = max(1, _CELLS // max(1, centers, x.shape[1]))
    for s in range(0, len(x), step):
        yield (x[s:s + step], *[c[s:s + step] for c in rest])


def square_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Rows by centres; differences are squared as such, so equal points are exactly 0 apart."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centers[None, :, j]) ** 2
    return out


def _seeds(points: DataFrame, many: int, seed: int) -> np.ndarray:
    """Candidate centres: per round ``many`` points drawn in proportion to weight times squared distance, without replacement.

    The smallest -log(u) / (weight * distance) are such a draw; every task passes on only its ``many`` smallest.
    """
    first = points.orderBy(F.xxhash64("xs", F.lit(seed)), "xs").limit(1).collect()
    found = np.array([r["xs"] for r in first], dtype=float)
    for r in range(SEED_ROUNDS if len(found) else 0):
        u = (F.pmod(F.xxhash64("xs", F.lit(seed), F.lit(r)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

        def draw(batches: Iterator[pa.RecordBatch], found: np.ndarray = found) -> Iterator[pa.RecordBatch]:
            best, keys = np.zeros((0, found.shape[1])), np.zeros(0)
            for batch in batches:
                for x, w, race in _blocks(batch, len(found)):
                    cost = w * square_distances(x, found).min(axis=1)
                    far = cost > 0
                    best, keys = np.concatenate([best, x[far]]), np.concatenate([keys, race[far] / cost[far]])
                    if len(keys) > many:
                        first = np.argpartition(keys, many)[:many]
                        best, keys = best[first], keys[first]
            yield pa.RecordBatch.from_arrays([pa.array(best.tolist(), pa.list_(pa.float64())), pa.array(keys)], names=["xs", "key"])

        drawn = points.select("xs", "w", (-F.log(u)).alias("race")).mapInArrow(draw, "xs array<double>, key double").orderBy("key", "xs").limit(many).collect()
        if not drawn:
            break
        found = np.concatenate([found, np.array([q["xs"] for q in drawn], dtype=float)])
    return found


def _totals(points: DataFrame, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per set of centres: sums of the points nearest to each, their weights, and the squared distances; ties go to the first centre."""
    ends = np.cumsum([len(c) for c in fits])
    every, width = np.concatenate(fits), fits[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, costs = np.zeros((len(every), width + 1)), np.zeros(len(fits))
        for batch in batches:
            for x, w in _blocks(batch, len(every)):
                near = (every**2).sum(axis=1) - 2 * (x @ every.T)  # squared distances less those of the points to zero
                weighted = np.concatenate([x, np.ones((len(x), 1))], axis=1) * w[:, None]
                for i, end in enumerate(ends):
                    start = end - len(fits[i])
                    label = near[:, start:end].argmin(axis=1)
                    sums[start:end] += (label[None, :] == np.arange(end - start)[:, None]).astype(float) @ weighted
                    costs[i] += w @ ((x - fits[i][label]) ** 2).sum(axis=1)
        at = np.concatenate([np.repeat(np.arange(len(every)), width + 1), np.full(len(fits), -1)])
        column = np.concatenate([np.tile(np.arange(width + 1), len(every)), np.arange(len(fits))])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(column), pa.array(np.concatenate([sums.ravel(), costs]))], names=["at", "c", "v"])

    sums, costs = np.zeros((len(every), width + 1)), np.zeros(len(fits))
    for r in points.select("xs", "w").mapInArrow(add, "at bigint, c bigint, v double").groupBy("at", "c").agg(F.sum("v").alias("v")).collect():
        if r["at"] < 0:
            costs[r["c"]] = r["v"]
        else:
            sums[r["at"], r["c"]] = r["v"]
    return [(sums[e - len(c):e, :-1], sums[e - len(c):e, -1], float(costs[i])) for i, (c, e) in enumerate(zip(fits, ends, strict=True))]


def _choose(found: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the candidates, each drawn in proportion to weight times squared distance to those before."""
    chosen = [int(rng.choice(len(found), p=weight / weight.sum()))]
    while len(chosen) < min(k, len(found)):
        cost = weight * square_distances(found, found[chosen]).min(axis=1)
        if not cost.any():
            break
        chosen.append(int(rng.choice(len(found), p=cost / cost.sum())))
    return found[chosen]


def fit_kmeans(points: DataFrame, ks: list[int], seed: int = 42, starts: int = 4, rounds: int = 20, tol: float = 1e-4, first: np.ndarray | None = None) -> dict[int, Fit]:
    """Best fit per k: of ``starts`` starts that with the smallest inertia after a few rounds goes on; its centres are sorted.

    ``points(xs array<double>)`` has a row per point. A start ends when no centre moves by more than ``tol`` or after
    ``rounds``; every round is one pass for all of them. ``first`` gives the starting centres instead of drawing them (``ks`` has
    its length alone). Tables with fewer different points than k give fewer centres, empty ones none.
    """
    table = weighted_points(points)
    if first is None:
        found = _seeds(table, 2 * max(ks), seed)
        if not len(found):
            return {k: Fit(k, np.zeros((0, 0)), 0.0, False) for k in ks}
        weight = _totals(table, [found])[0][1]
        fits = [Fit(k, _choose(found, weight, k, np.random.default_rng([seed, k, s]))) for k in ks for s in range(starts)]
    else:
        fits = [Fit(len(first), np.array(first, dtype=float))]
    for r in range(rounds + 1):
        if r == TRIAL_ROUNDS:
            fits = _best(fits)
        active = [f for f in fits if f.moving]
        if not active:
            break
        for f, (sums, n, cost) in zip(active, _totals(table, [f.centers for f in active]), strict=True):
            f.inertia = cost
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], f.centers)
            f.moving = r < rounds and bool(np.abs(moved - f.centers).max() > tol)
            f.centers = moved if r < rounds else f.centers
    fits = _best(fits)
    for f in fits:
        f.centers = np.array(sorted(f.centers.tolist()))
    return {f.k: f for f in fits}


def _best(fits: list[Fit]) -> list[Fit]:
    """The fit with the smallest inertia for each k; the earlier one of equals."""
    return [min((f for f in fits if f.k == k), key=lambda f: f.inertia) for k in dict.fromkeys(f.k for f in fits)]
