"""Leading singular vectors of tables with very many columns, without their d x d products.

A block of k + 10 random directions is driven into the leading subspace: every round each task multiplies its rows with the block
and back again, the partial d x k results are summed in a tree, and the driver orthogonalises their sum. At the end the tall
blocks (rows times block) are reduced by local QR steps in a tree, whose last factor tells singular values and the rotation. The
driver holds a few d x k matrices, whatever the number of rows; no task holds more than a batch of rows beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import num_sql

#: Columns of a partial result that travel as one row, and partial results that one step of the tree sums.
CHUNK, FAN = 512, 32
#: Directions beyond k, rounds at most, and the residual, as a share of the largest value, that ends them.
EXTRA, ROUNDS, TOLERANCE = 10, 30, 1e-10
_PART = "chunk int, bucket int, v array<double>"


def _rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.expr(f"array({', '.join(num_sql(c) for c in cols)})").alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Rows of the batches as matrices with NaN for missing cells, a few million cells at a time."""
    step = max(1, 4_000_000 // d)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.column(0).slice(start, step)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _parts(m: np.ndarray) -> pa.RecordBatch:
    """A d x c matrix as rows of ``CHUNK`` lines each; the bucket spreads the tasks over the first step of the tree."""
    pieces = [m[a:a + CHUNK].ravel() for a in range(0, len(m), CHUNK)]
    context = TaskContext.get()
    bucket = (context.partitionId() if context else 0) // FAN
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(pieces)), pa.int32()), pa.array([bucket] * len(pieces), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["chunk", "bucket", "v"])


def _summed(parts: DataFrame, tasks: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the partial matrices, in a tree of grouped sums; what reaches the driver is one matrix."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bucket": [int(pdf["bucket"].iloc[0]) // FAN], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    buckets = -(-tasks // FAN)
    while True:
        parts = parts.groupBy("chunk", "bucket").applyInPandas(add, _PART)
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN)
    out = np.zeros(shape)
    for r in parts.toLocalIterator():
        a = r["chunk"] * CHUNK
        piece = np.asarray(r["v"]).reshape(-1, shape[1])
        out[a:a + len(piece)] += piece
    return out


def _pass(df: DataFrame, cols: list[str], width: int, fold: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """d x width matrix that ``fold`` builds up from the rows of every task, summed over the tasks."""
    d = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((d, width))
        for x in _matrices(batches, d):
            fold(acc, x)
        yield _parts(acc)

    rows = _rows(df, cols)
    return _summed(rows.mapInArrow(run, _PART), rows.rdd.getNumPartitions(), (d, width))


def _last_factor(df: DataFrame, cols: list[str], shift: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Triangular factor of (rows - shift) x block: a QR per task, then QR steps over stacked factors in a tree."""
    d, l = block.shape
    shared = df.sparkSession.sparkContext.broadcast((shift, block))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, q = shared.value
        r = np.zeros((0, l))
        for x in _matrices(batches, d):
            r = np.linalg.qr(np.concatenate([r, np.nan_to_num(x - m) @ q]), mode="r")
        # factors are stacked, not summed: as many rows as the block has columns, zeros below
        full = np.zeros((l, l))
        full[:len(r)] = r
        yield _parts(full)

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.asarray(v).reshape(l, l) for v in pdf["v"]]), mode="r")
        return pd.DataFrame({"chunk": [0], "bucket": [int(pdf["bucket"].iloc[0]) // FAN], "v": [r.ravel()]})

    rows = _rows(df, cols)
    parts, buckets = rows.mapInArrow(local, _PART), -(-rows.rdd.getNumPartitions() // FAN)
    while True:
        parts = parts.groupBy("chunk", "bucket").applyInPandas(stack, _PART)
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN)
    got = [np.asarray(r["v"]).reshape(l, l) for r in parts.toLocalIterator()]
    return np.linalg.qr(np.concatenate(got), mode="r") if got else np.zeros((l, l))


def leading(df: DataFrame, cols: list[str], k: int, center: bool, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, float]:
    """(means, k largest squared singular values, their right vectors d x k, rows, sum of squares) of the numeric columns.

    With ``center`` the columns are centred, a missing cell is the mean; else a missing cell is 0. The sum of squares has
    the means taken off in either case. Rounds end when the residual of every leading vector is below ``TOLERANCE`` of the
    largest value, or after ``ROUNDS``: directions that hardly stand out of the others are then told less exactly.
    """
    if len(cols) * (k + EXTRA) > 2**27:
        raise ValueError(f"{len(cols)} columns times {k} vectors do not fit the driver: ask for fewer")
    d, l = len(cols), min(len(cols), k + EXTRA)

    def count(acc: np.ndarray, x: np.ndarray) -> None:
        known = ~np.isnan(x)
        acc[:, 0] += known.sum(axis=0)
        acc[:, 1] += np.where(known, x, 0).sum(axis=0)
        acc[0, 2] += len(x)

    got = _pass(df, cols, 3, count)
    means, n = got[:, 1] / np.maximum(got[:, 0], 1), int(got[0, 2])
    shift = means if center else np.zeros(d)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, l)))
    squares = 0.0
    for _ in range(ROUNDS):
        shared = df.sparkSession.sparkContext.broadcast((shift, q))

        def multiply(acc: np.ndarray, x: np.ndarray, shared=shared) -> None:
            m, block = shared.value
            y = np.nan_to_num(x - m)
            acc[:, :l] += y.T @ (y @ block)
            acc[:, l] += (y * y).sum(axis=0)

        z = _pass(df, cols, l + 1, multiply)
        squares, z = float(z[:, l].sum()) - (0.0 if center else n * float(means @ means)), z[:, :l]
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        top = np.argsort(values)[::-1][:k]
        off = z @ turn[:, top] - (q @ turn[:, top]) * values[top]
        if l == d or np.abs(off).max(initial=0.0) <= TOLERANCE * max(values.max(initial=0.0), 1e-300):
            break
        q, _ = np.linalg.qr(z)
    _, s, v = np.linalg.svd(_last_factor(df, cols, shift, q))
    return means, s[:k] ** 2, q @ v[:k].T, n, squares
