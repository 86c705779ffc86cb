"""Packed token-id matrices: best-fit-decreasing packing per shard.

Documents are encoded and cut losslessly into segments of at most ``LENGTH`` ids, which a hash deals to shards of about
``SHARD_TOKENS`` tokens, so that a shard stays small whatever the corpus. Within a shard the segments, longest first, go
to the row with the least room that still fits them; a segment tree over the possible amounts of room finds it in
logarithmic time. Each shard becomes blocks of rows: an id matrix, cumulative segment lengths and positions that restart
with every segment.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import blocks, load, query, ref
from prepspark.session import materialize

LENGTH = 2048
SHARD_TOKENS = 2_000_000
#: Rows of one matrix.
ROWS = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """Byte-level BPE of a rank file; no text is a special token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(enc, text: str) -> np.ndarray:
    """Ids of a whole text."""
    try:
        return enc.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        # The library's own splitter gives up on very long runs of blanks: split here, encode the parts.
        parts = regex.findall(enc._pat_str, text)
        return np.array([i for p in parts for i in enc._core_bpe.encode_single_piece(p.encode())], dtype=np.uint32)


def id_type(enc) -> np.dtype:
    """Little-endian type of the stored ids: 16 bits where the vocabulary allows."""
    return np.dtype("<u2" if enc.max_token_value < 1 << 16 else "<u4")


class Room:
    """Segment tree over amounts of room: whether some open row has at least, and at most, so much left."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The latest row with the least room of ``need`` or more, removed from the tree; None if there is none."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers by best fit decreasing; equal sizes in the given order. No size exceeds ``length``."""
    tree, rows = Room(length), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k])
        row, room = found if found else (len(rows), length)
        if found is None:
            rows.append([])
        rows[row].append(k)
        if room > sizes[k]:
            tree.put(row, room - sizes[k])
    return rows


def encoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, copy, segment, n, ids): the ids of each text, as ``id_type`` stores them, in segments of at most ``length``.

    ``copy`` is the start of the text's SHA-256: it tells rows of equal id apart by their text. A text without tokens has
    no segment.
    """
    path = path or default_path()
    src = df.select(ref(doc_id).alias("doc_id"), F.sha2(ref(text).cast("string"), 256).substr(1, 16).alias("copy"), ref(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        kind, width = id_type(enc), id_type(enc).itemsize
        for batch in batches:
            for start, texts in blocks(batch.column(2)):
                row, seg, n, ids = [], [], [], []
                for k, t in enumerate(texts):
                    whole = ids_of(enc, t).astype(kind).tobytes()
                    for s, a in enumerate(range(0, len(whole), width * length)):
                        part = whole[a:a + width * length]
                        row.append(start + k)
                        seg.append(s)
                        n.append(len(part) // width)
                        ids.append(part)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(seg, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())],
                    names=["doc_id", "copy", "segment", "n", "ids"])

    return src.mapInArrow(run, f"doc_id {kind}, copy string, segment int, n int, ids binary")


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
           shard_tokens: int = SHARD_TOKENS, pad: int = 0) -> DataFrame:
    """Blocks of packed rows: shard, block, n_rows, n_tokens, id_bytes, ids, cu_seqlens, row_offsets, positions, doc_ids, segments.

    ``ids`` is an (n_rows x length) matrix of little-endian numbers of ``id_bytes`` bytes, filled up with ``pad``; ``positions`` the
    16-bit matrix of positions, restarting with 0 at every segment; ``cu_seqlens`` the cumulative segment lengths of each row from 0,
    rows one after the other, ``row_offsets`` where each row's begin; ``doc_ids`` and ``segments`` name the segments in order. Null
    texts have no tokens; equal rows are packed as often as they occur. An empty table gives no block.
    """
    if not 0 < length <= 65_535:
        raise ValueError("length must lie between 1 and 65,535")
    path = path or default_path()
    width = id_type(encoding(path))
    pieces = materialize(encoded(df, doc_id, text, path, length), "segments")
    total = pieces.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    out = (f"shard bigint, block int, n_rows int, n_tokens bigint, id_bytes int, ids binary, cu_seqlens array<int>, row_offsets array<int>, "
           f"positions binary, doc_ids array<{kind}>, segments array<int>")

    def lay(key, table):
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "copy", "segment")])
        n = table["n"].to_numpy()
        ids, docs, segments = table["ids"], table["doc_id"], table["segment"].to_numpy()
        cells = []
        rows = pack(n.tolist(), length)
        for b, a in enumerate(range(0, len(rows), ROWS)):
            some = rows[a:a + ROWS]
            matrix, places = np.full((len(some), length), pad, width), np.zeros((len(some), length), "<u2")
            order, ends, offsets = [], [], [0]
            for r, segs in enumerate(some):
                at = 0
                ends.append(0)
                for k in segs:
                    matrix[r, at:at + n[k]] = np.frombuffer(ids[k].as_py(), width)
                    places[r, at:at + n[k]] = np.arange(n[k])
                    at += int(n[k])
                    ends.append(at)
                order += segs
                offsets.append(len(ends))
            cells.append((key[0].as_py(), b, len(some), int(n[order].sum()), width.itemsize, matrix.tobytes(), ends, offsets, places.tobytes(),
                          docs.take(pa.array(order)).to_pylist(), segments[order].tolist()))
        names = ["shard", "block", "n_rows", "n_tokens", "id_bytes", "ids", "cu_seqlens", "row_offsets", "positions", "doc_ids", "segments"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(),
                 pa.list_(docs.type), pa.list_(pa.int32())]
        return pa.table([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], names=names)

    # Segments, not documents, are dealt, by their place in the written table: neither long texts nor equal rows crowd a shard.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards).cast("bigint")))
    return dealt.groupBy("shard").applyInArrow(lay, out)


def unpacked(blocks_: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, segment, ids) of every segment of packed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").reshape(-1, length)
                at, ids = 0, []
                for r in range(row["n_rows"]):
                    ends = row["cu_seqlens"][row["row_offsets"][r]:row["row_offsets"][r + 1]]
                    ids += [matrix[r, a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["segments"], pa.int32()),
                     pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "segment", "ids"])

    kind = blocks_.schema["doc_ids"].dataType.elementType.simpleString()
    cols = ["ids", "id_bytes", "n_rows", "cu_seqlens", "row_offsets", "doc_ids", "segments"]
    return blocks_.select(*cols).mapInArrow(run, f"doc_id {kind}, segment int, ids array<int>")


@query("op9_packed_ids")
def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))
