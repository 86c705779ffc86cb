"""Prefix trie of conversations, with subtree totals by time-forward processing.

Turns become digests first; one shuffle by base conversation and an external sort then let a stream rebuild every conversation
and name each of its prefixes by a chained 128-bit digest. Distinct prefixes are the nodes. Totals of subtrees flow upwards:
nodes are sorted by reverse level order, every node takes what its children sent from a priority queue that spills, adds its
own share and sends the sum on to the place and time of its parent. Nodes with many members are few; they are cut off, the
subtrees below them are the shards, and the totals of shard roots flow through the cut-off top in a second run.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import load, query, ref
from prepspark.session import materialize

GROUP = 20
#: Original turns that may be taken from the base conversation, at most.
SHARED = 3
#: Members beyond which a node belongs to the top: at least so many, and so many that the top has no more than ``TOP_NODES`` nodes.
LIGHT = 64
TOP_NODES = 50_000
#: Messages a queue holds in memory before the later half goes to a sorted run.
QUEUE = 200_000
CHUNK = 65_536
_ROWS = 20_000
ROOT = bytes(16)
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_PATH = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, words bigint, ends boolean"
_NODE = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n_convs bigint"


def taken(conv_id: int) -> int:
    """Turns a conversation takes from its base: unsigned CRC-32 of its decimal id, modulo four."""
    return zlib.crc32(str(conv_id).encode()) % (SHARED + 1)


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(base, conv_id, turn, role, digest, words) of every turn with a conversation; null role and text are empty."""
    said = F.coalesce(ref(text).cast("string"), F.lit(""))
    rows = df.where(ref(conv_id).isNotNull()).select(
        ref(conv_id).cast("bigint").alias("conv_id"), ref(turn).alias("turn"), F.coalesce(ref(role).cast("string"), F.lit("")).alias("role"), said.alias("text"))
    return rows.selectExpr(
        f"conv_id - conv_id % {GROUP} AS base", "conv_id", "turn", "role", "substr(unhex(sha2(text, 256)), 1, 16) AS digest",
        r"CAST(regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS BIGINT) AS words")


class _Batches:
    """Rows gathered into record batches of one schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def full(self) -> bool:
        return len(self.rows) >= _ROWS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _fields(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (p.split() for p in ddl.split(", "))])


def paths(rows: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv_id, words, ends): every prefix of every rebuilt conversation, the textless root included.

    k is the node, p its parent. One shuffle; a conversation is read as a sorted stream of turns and never held, its base's
    first turns excepted. Equal turns are told apart by role, then by the digest of the text; repeated rows all stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(_fields(_PATH))
        base = conv = None
        heads: list[tuple[str, bytes, int]] = []
        place = h = depth = 0
        key, row = ROOT, None

        def step(role: str, digest: bytes, words: int) -> None:
            nonlocal key, depth, row
            out.rows.append((*row, False))
            name = role.encode("utf-8", "surrogatepass")
            after = hashlib.blake2b(b"%b%d:%b%b" % (key, len(name), name, digest), digest_size=16).digest()
            depth += 1
            row = (*struct.unpack(">qq", after), *struct.unpack(">qq", key), depth, conv, words)
            key = after

        for batch in batches:
            for b, c, role, digest, words in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if b != base:
                    base, heads = b, []
                if c != conv or row is None:
                    if row is not None:
                        out.rows.append((*row, True))
                    conv, place, depth, key = c, 0, 0, ROOT
                    h = 0 if c == b else taken(c)
                    row = (0, 0, None, None, 0, c, 0)
                    for head in heads[:h]:
                        step(*head)
                if c == b and place < SHARED:
                    heads.append((role, digest, words))
                if place >= h:
                    step(role, digest, words)
                place += 1
                if out.full():
                    yield out.take()
        if row is not None:
            out.rows.append((*row, True))
        yield out.take()

    order = rows.withColumn("later", F.col("conv_id") != F.col("base")).repartition("base").sortWithinPartitions(
        "base", "later", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return order.select("base", "conv_id", "role", "digest", "words").mapInArrow(run, _PATH)


Message = tuple[int, int, int, int, int, int]


class SpillingQueue:
    """Priority queue of messages (time, k1, k2, children, leaves, saved) with bounded memory.

    When it is full, the later half becomes a sorted run in an anonymous file of the executor's scratch space, as Spark's own
    sorts spill: no other task reads it, it goes with the task, and a lost executor's task starts anew.
    """

    _RECORD = struct.Struct(">6q")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spills = max(2, limit), [], [], 0

    def push(self, message: Message) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        half = len(self.heap) // 2
        file = tempfile.TemporaryFile()
        for m in self.heap[half:]:
            file.write(self._RECORD.pack(*m))
        del self.heap[half:]
        file.seek(0)
        self.spills += 1
        self._advance(self.spills, self._read(file))

    def _read(self, file) -> Iterator[Message]:
        with file:
            while block := file.read(self._RECORD.size * 4096):
                yield from self._RECORD.iter_unpack(block)

    def _advance(self, run: int, rest: Iterator[Message]) -> None:
        for m in rest:
            heapq.heappush(self.runs, (m, run, rest))
            return

    def receive(self, to: tuple[int, int, int]) -> Iterator[Message]:
        """Messages to one receiver, taken off the queue; receivers ask in order."""
        while self.heap and self.heap[0][:3] == to:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:3] == to:
            m, run, rest = heapq.heappop(self.runs)
            self._advance(run, rest)
            yield m


_TOTALS = f"{_NODE}, n_children bigint, n_leaves bigint, saved_tokens bigint, up boolean"


def forward(nodes: DataFrame, queue: int = QUEUE) -> DataFrame:
    """Totals of every node from rows (node columns, words, top, c0, l0, s0), partitioned by shard, in reverse level order.

    ``top`` marks shard roots: their totals leave the shard (column ``up``). c0, l0 and s0 are what arrived from shards below.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = _Batches(_fields(_TOTALS)), SpillingQueue(queue)
        for batch in batches:
            for k1, k2, p1, p2, depth, conv, n, words, top, children, leaves, saved in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for _, _, _, c, x, s in waiting.receive((-depth, k1, k2)):
                    children, leaves, saved = children + c, leaves + x, saved + s
                leaves, saved = leaves or 1, saved + (n - 1) * words
                out.rows.append((k1, k2, p1, p2, depth, conv, n, children, leaves, saved, top))
                if not top:
                    waiting.push((1 - depth, p1, p2, 1, leaves, saved))
                if out.full():
                    yield out.take()
        yield out.take()

    names = [p.split()[0] for p in _NODE.split(", ")]
    return nodes.select(*names, "words", "top", "c0", "l0", "s0").mapInArrow(run, _TOTALS)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv_id): SHA-256 of the ids, numerically ascending, comma-joined.

    Ids are dealt by ranges of (node, id), so a node where a third of all conversations end is joined into long pieces by many
    tasks; only the pieces of a node meet, as a sorted stream.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, first, ids, size = _Batches(_fields("k1 bigint, k2 bigint, first bigint, ids string")), None, 0, [], 0
        for batch in batches:
            for k1, k2, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (k1, k2) != node or size > CHUNK:
                    if ids:
                        out.rows.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (k1, k2), c, [], 0
                ids.append(str(c))
                size += 1 + len(ids[-1])
                if out.full():
                    yield out.take()
        if ids:
            out.rows.append((*node, first, ",".join(ids)))
        yield out.take()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, state = _Batches(_fields("k1 bigint, k2 bigint, ends_sha256 string")), None, None
        for batch in batches:
            for k1, k2, ids in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (k1, k2) != node:
                    if node is not None:
                        out.rows.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                if out.full():
                    yield out.take()
        if node is not None:
            out.rows.append((*node, state.hexdigest()))
        yield out.take()

    parts = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    joined = parts.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, ids string")
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids").mapInArrow(
        digests, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(df: DataFrame, light: int = LIGHT, queue: int = QUEUE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. A conversation whose rebuilt form has no turn is a member of the root; an
    empty table has no root. Turns that tie are ordered by role, then by the SHA-256 of the text; extra columns are ignored.
    """
    every = materialize(paths(turns(df)), "trie-paths")
    # Members are counted before the shuffle, so a prefix that most conversations share is no hot key.
    nodes = materialize(
        every.groupBy("k1", "k2", "p1", "p2", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-nodes")
    total = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    light = max(light, total // TOP_NODES)
    in_top = (F.col("n_convs") > light) | (F.col("depth") == 0)
    # Fewer than TOP_NODES nodes and the root: each stands for more than one in TOP_NODES of all prefixes.
    top = materialize(nodes.where(in_top), "trie-top")
    names = F.broadcast(top.select("k1", "k2"))
    first = every.join(names, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(
        F.min("depth").alias("cut"), F.min_by("k1", "depth").alias("s1"), F.min_by("k2", "depth").alias("s2"))
    none = {c: F.lit(0).cast("bigint") for c in ("c0", "l0", "s0")}
    shards = nodes.where(~in_top).join(first, "conv_id").withColumns({"top": F.col("depth") == F.col("cut"), **none})
    shards = shards.repartition("s1", "s2").sortWithinPartitions(F.col("depth").desc(), "k1", "k2")
    below = materialize(forward(shards, queue), "trie-shards")
    arrived = below.where("up").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("c0"), F.sum("n_leaves").alias("l0"), F.sum("saved_tokens").alias("s0"))
    crown = top.join(arrived, ["k1", "k2"], "left").fillna(0, ["c0", "l0", "s0"]).withColumn("top", F.col("depth") == 0)
    crown = forward(crown.repartition(1).sortWithinPartitions(F.col("depth").desc(), "k1", "k2"), queue).withColumn("up", F.lit(True))
    # Parents in the top may have any number of children: they are looked up from a broadcast. The others have at most ``light``.
    parent = lambda t: t.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    upper = below.where("up").unionByName(crown).join(F.broadcast(parent(top)), ["p1", "p2"], "left")
    lower = below.where("NOT up").join(parent(nodes.where(~in_top)), ["p1", "p2"], "left")
    ended = ends_digests(every.where("ends"))
    return upper.unionByName(lower).join(ended, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


_SQL = r"""
WITH k AS (SELECT DISTINCT conv_id AS c, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b)), 4294967295) AS crc
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || sha256(coalesce(text, '')) AS said,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT k.c, 0 AS own, i, said, words FROM k JOIN t ON t.c = k.c - k.c % 20 AND i < xor(crc, 4294967295) % 4
  UNION ALL SELECT k.c, 1, i, said, words FROM k JOIN t ON t.c = k.c AND i >= xor(crc, 4294967295) % 4),
p AS (SELECT c, row_number() OVER w AS d, string_agg(said, '|') OVER w AS path, words, lead(i) OVER w IS NULL AS ends FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i)
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM r) FROM k),
q AS (SELECT *, CASE WHEN d > 0 THEN lag(path) OVER (PARTITION BY c ORDER BY d) END AS up FROM p),
n AS (SELECT path, d, up, words, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY path, d, up, words),
h AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN h USING (path)),
s AS (SELECT a.path, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM m JOIN q a ON a.c = m.c AND a.d <= m.d GROUP BY a.path)
SELECT m.c AS conv_id, m.d::BIGINT AS depth, u.c AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.path = s.path LEFT JOIN n u ON m.up = u.path
"""


@query("op11_conversation_trie", _SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))
