"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; working arrays take a small multiple of it.
BLOCK_BYTES = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and, where SQL can express it, the SQL that gives the same rows."""
    def register(fn: Callable) -> Callable:
        @wraps(fn)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application; tasks import it from there.

    The archive is read by the driver only, which serves it to the executors.
    """
    context = spark.sparkContext
    if _shipped.get("app") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="prepspark-code-")) / "prepspark_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(path))
    _shipped["app"] = context.applicationId


_shipped: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ref(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) runs of about ``limit`` bytes; null becomes the empty text, a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:start + 100_000]), limit, side="right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse: prefix sums of rolling hashes."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    return up, down


def map_text(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Add the columns ``fn`` computes from a run of texts to the columns ``keep``; narrow, one pass, bounded memory.

    ``schema`` lists the new columns (DDL). The order and number of rows stay.
    """
    src = df.select(*[ref(c) for c in keep], ref(text).cast("string").alias("__text"))
    fields = src.select(*[ref(c) for c in keep]).schema
    out = fields
    for f in _parse(df.sparkSession, schema):
        out = out.add(f)
    names = [f.name for f in out][len(keep):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for start, texts in blocks(column):
                made = fn(texts)
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *[as_arrow(made[n]) for n in names]], names=[*keep, *names])

    return src.mapInArrow(run, out)


def edit_text(df: DataFrame, fn: Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch], text: str = "text") -> DataFrame:
    """Rows of ``df`` as ``fn`` returns them from runs of rows and their texts: same columns, values changed or rows left out."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(at)):
                yield fn(batch.slice(start, len(texts)), texts)

    return df.mapInArrow(run, df.schema)


def as_arrow(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def _parse(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema


#: Rows and bytes up to which a lookup side is broadcast; beyond, the join shuffles.
SMALL_ROWS = 100_000
SMALL_BYTES = 32_000_000


def flagged(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Left join with one row of ``marks`` per key. A few marks are broadcast: their rows and bytes are counted first."""
    wide = [c for c, t in marks.dtypes if t in ("string", "binary")]
    size = F.lit(8 * len(marks.columns)) + sum((F.coalesce(F.octet_length(ref(c)), F.lit(0)) for c in wide), F.lit(0))
    n, total = marks.agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    few = n <= SMALL_ROWS if not wide else total <= SMALL_BYTES
    return df.join(F.broadcast(marks) if few else marks, key, "left")
