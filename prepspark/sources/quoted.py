"""Quoted CSV files read in parts, whatever line breaks their cells hold.

A file is scanned line by line in byte-range splits. The first scan only counts quotes, in one aggregation: it tells for every split
whether the number of quotes in it is odd, and so, summed along a file, whether a split starts inside a quoted cell. The second scan
cuts each split into records from its true row start, a batch of lines at once; the pieces of a record that crosses split borders come
from a scan that returns nothing else and are put together by a small shuffle. Records become rows by the built-in CSV
expression. A file of any size is read by as many tasks as it has splits.

Quotes must balance, as in files where a quote inside a cell is doubled; a file where they do not is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "file string, utf8 boolean, first boolean, record binary"
_PIECE = "file string, owner bigint, start bigint, utf8 boolean, first boolean, record binary"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, split, line): raw lines with the file and first byte of the split they begin in, and a hash of both; rows of a
    split come in order.

    Only a line feed ends a line, so a carriage return inside a cell stays.
    """
    text = spark.read.text(path, lineSep="\n")
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), split.alias("split"), F.col("value").alias("line"))


def valid_utf8() -> Column:
    """Whether all lines of a group are valid UTF-8."""
    return F.bool_and(F.is_valid_utf8("line"))


def _quotes(source: DataFrame, find_encoding: bool) -> DataFrame:
    """One row per split: whether its quotes are odd in number, whether a record that was open at its start ends in it, which a line
    with an odd number of quotes does, and, if asked for, whether it is valid UTF-8."""
    odd = F.expr("""(octet_length(line) - octet_length(replace(line, '"', ''))) % 2""")
    utf8 = valid_utf8() if find_encoding else F.lit(True)
    return source.groupBy("file", "start", "split").agg((F.sum(odd) % 2 == 1).alias("odd"), (F.max(odd) == 1).alias("closes"), utf8.alias("utf8"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """(split, lines) of the splits a batch holds, in order."""
    splits = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(splits[a]), batch.column(1).slice(a, b - a)


def _parity(column: pa.Array) -> np.ndarray:
    """Quotes up to and with each line, modulo two."""
    return np.cumsum(np.asarray(pc.count_substring(column, b'"'))) & 1


def _joined(column: pa.Array, ends: np.ndarray) -> pa.Array:
    """Lines joined by line feeds; ``ends`` holds the number of lines up to the end of each text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), column), b"\n")


def split_states(found: list[tuple[str, int, bool, bool]]) -> dict[tuple[str, int], int | None]:
    """For every split the start of the split whose last record is still open where it begins, or None.

    ``found`` holds (file, start, odd, closes) of all splits. A file whose quotes do not balance is an error.
    """
    out: dict[tuple[str, int], int | None] = {}
    file, owner = None, None
    for name, start, odd, closes in sorted(found):
        if name != file:
            if owner is not None:
                raise ValueError(f"quotes do not balance in {file}")
            file = name
        out[name, start] = owner
        if owner is None:
            owner = start if odd else None
        elif not odd and closes:
            owner = start  # the open record ends here and another one stays open
        elif odd:
            owner = None
    if owner is not None:
        raise ValueError(f"quotes do not balance in {file}")
    return out


def _cut(states: Callable[[], dict], whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cut of splits into records. ``whole`` returns the records that lie in one split, else only the pieces of the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = states()
        now, held, inside = None, [], False
        file, start, utf8, opened, fresh = None, 0, True, None, False

        def made(texts: pa.Array) -> pa.RecordBatch:
            nonlocal fresh
            n, one, fresh = len(texts), fresh, False
            firsts = np.zeros(n, bool)
            firsts[0] = one
            flags = {"utf8": pa.repeat(utf8, n), "first": pa.array(firsts), "record": texts}
            if whole:
                return pa.RecordBatch.from_pydict({"file": pa.array([file if one else None] + [None] * (n - 1), pa.string()), **flags})
            return pa.RecordBatch.from_pydict({"file": pa.repeat(file, n), "owner": pa.array([opened] * n, pa.int64()), "start": pa.array([start] * n, pa.int64()), **flags})

        def rest() -> Iterator[pa.RecordBatch]:
            """What is held as one text: a whole record, or a piece of the one that began in split ``opened``."""
            nonlocal held, fresh
            column, held = pa.concat_arrays(held) if held else None, []
            if column is not None:
                yield made(_joined(column, np.array([len(column)])))
            fresh = False

        for batch in batches:
            for split, column in _runs(batch):
                if split != now:
                    if inside and not whole:
                        yield from rest()
                    if split not in known:
                        raise RuntimeError("the splits of a file changed between two scans")
                    # In a split that starts inside a cell, the lines up to the end of that record belong to its owner.
                    now, held = split, []
                    file, start, opened, utf8 = known[split]
                    inside, fresh = opened is not None, start == 0
                p = _parity(column) ^ int(inside)
                ends, at = np.flatnonzero(p == 0) + 1, 0  # a record ends with every line after which no quote is open
                if inside:
                    at = int(ends[0]) if len(ends) else len(column)
                    if not whole or opened == start:
                        held.append(column.slice(0, at))
                    if len(ends):
                        if whole == (opened == start):
                            yield from rest()
                        held, fresh, ends = [], False, ends[1:]
                if len(ends):
                    if whole:
                        yield made(_joined(column.slice(at, int(ends[-1]) - at), ends - at))
                    fresh, at = False, int(ends[-1])
                inside = bool(p[-1])
                if at < len(column):
                    held, opened = [column.slice(at)], start
        if inside and not whole:
            yield from rest()

    return cut


def records(spark: SparkSession, path: str | list[str], find_encoding: bool = False) -> DataFrame:
    """(file, utf8, first, record): the text of every record as bytes, without its end of line; ``first`` marks the first one of a file,
    which alone carries the name of the file. ``utf8`` tells, if asked for, whether all lines of its file are valid UTF-8.

    What reaches the driver is a row per split, as many as the splits that the driver lists anyway. All scans must cut files
    alike; if the settings that decide it change in between, the later one ends with an error.
    """
    source = lines(spark, path)
    found = _quotes(source, find_encoding).collect()
    owners = split_states([(r["file"], r["start"], r["odd"], r["closes"]) for r in found])
    other = {r["file"] for r in found if not r["utf8"]}
    states = {r["split"]: (r["file"], r["start"], owners[r["file"], r["start"]], r["file"] not in other) for r in found}
    if len(states) < len(found):
        raise RuntimeError("two splits share a hash")
    shared = spark.sparkContext.broadcast(states)

    source = source.select("split", F.col("line").cast("binary").alias("line"))
    whole = source.mapInArrow(_cut(lambda: shared.value, True), _RECORD)
    if all(owner is None for owner in owners.values()):
        return whole
    # Pieces meet by the record they are parts of: no more of them than splits.
    pieces = source.mapInArrow(_cut(lambda: shared.value, False), _PIECE)
    parts = pieces.groupBy("file", "owner").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
    joined = F.expr("aggregate(slice(parts, 2, greatest(size(parts) - 1, 0)), parts[0].record, (a, x) -> concat(a, X'0A', x.record))")
    return whole.unionByName(parts.select("file", "utf8", "first", joined.alias("record")))


def _text(encoding: str | None) -> str:
    """A record as a string; without an encoding in the one found for its file."""
    text = "CAST(record AS STRING)"
    if encoding is None:
        text = f"IF(utf8, {text}, decode(record, 'ISO-8859-1'))"
    elif encoding.upper().replace("-", "") != "UTF8":
        text = f"decode(record, '{encoding}')"
    return _chomped(text)


def _chomped(text: str) -> str:
    return f"IF(endswith({text}, '\\r'), regexp_replace({text}, '\\\\r$', ''), {text})"


def infer(rows: DataFrame, names: list[str], options: dict[str, str]) -> T.StructType:
    """Types of the columns from all records, in one aggregation: the first of int, bigint, double, date, timestamp, boolean
    that every cell with content can be cast to, else string."""
    ladder = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    cells = rows.select(F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r")).select("r.*")
    counts = [F.count(f"c{i}") for i in range(len(names))]
    counts += [F.count(F.expr(f"try_cast(c{i} AS {t})")) for i in range(len(names)) for t in ladder]
    got = list(cells.agg(*[c.alias(f"a{k}") for k, c in enumerate(counts)]).first())
    out = T.StructType()
    for i, name in enumerate(names):
        fit = got[len(names) + i * len(ladder):][:len(ladder)]
        out = out.add(name, next((t for t, n in zip(ladder.values(), fit, strict=True) if got[i] and n == got[i]), T.StringType()))
    return out


def scan_quoted(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None, options: dict[str, str], encoding: str | None = "UTF-8",
) -> DataFrame:
    """Rows of header CSV files with line breaks in quotes, each file read in parts. ``options`` are those of the CSV expression.

    Without a schema the names are those of the first header and the types are inferred from all records. Blank records are skipped. The encoding
    must keep ASCII bytes as they are (UTF-8, ISO-8859-1 and the like); with None each file is read as UTF-8 if all of it is valid,
    else as ISO-8859-1.
    """
    found = records(spark, path, encoding is None)
    # Blank records are told by their bytes, so that no other record is decoded for it.
    rows = found.where(f"NOT first AND trim({_chomped('CAST(record AS STRING)')}) <> ''").select(F.expr(_text(encoding)).alias("record"))
    if schema is None:
        head = found.where("first").orderBy("file").limit(1).select(F.expr(_text(encoding)).alias("record")).first()
        if head is None:
            return spark.createDataFrame([], T.StructType())
        names = [c or f"_c{i}" for i, c in enumerate(_header(spark, head["record"]))]
        schema = infer(rows, names, options)
    return rows.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _header(spark: SparkSession, record: str) -> list[str]:
    cells = record.count(",") + 1
    got = spark.createDataFrame([(record,)], "record string").select(
        F.from_csv("record", ", ".join(f"c{i} string" for i in range(cells)), {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}).alias("r")).first()["r"]
    last = max((i for i in range(cells) if got[i] is not None), default=0)
    return [got[i] for i in range(last + 1)]
