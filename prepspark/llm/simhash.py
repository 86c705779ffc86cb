"""Near-duplicates by SimHash over four-word shingles, linked through a byte-position inverted index.

Fingerprints at most ``BITS`` bits apart differ in at most that many of their eight bytes, so they share ``8 - BITS`` bytes
at the same positions. The index posts each fingerprint under its positional bytes; lists are intersected four positions
at a time, so that a pair meets exactly in lists where its tally has reached the guaranteed minimum. Each pair of a list is
then verified bit by bit. Lists too long for pairs are not paired: their fingerprints are posted under every value within
``BITS / 2`` bits of them, where two fingerprints meet exactly if they are linked, and every list becomes a star.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import flagged, load, map_text, query, ref
from prepspark.llm.components import components
from prepspark.session import materialize

SHINGLE = 4
BITS = 4
#: Lists up to this many fingerprints are compared pairwise inside their task, longer ones through shared neighbours.
LIST = 2048
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_POSITIONS = list(combinations(range(8), 8 - BITS))


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of the shingles of a text, repeats included; fewer words: of the whole sequence; none: no hash."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half the shingle hashes of the text; no words: 0."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), dtype=np.uint64)
        if len(hashes):
            ones = np.zeros(64, dtype=np.int64)
            for a in range(0, len(hashes), 16_384):
                ones += np.unpackbits(hashes[a:a + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row plus ``fp``, the fingerprint as a signed 64-bit number. A null text has no words."""
    return map_text(df, lambda t: {"fp": pa.array(fingerprints(t).view(np.int64))}, "fp bigint", keep, text)


def links(fps: DataFrame, bits: int = BITS, limit: int = LIST) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect what the pairs at most ``bits`` apart connect, and no more.

    A list tells a spanning forest of its pairs, not the pairs. An empty table gives none.
    """
    if bits != BITS:
        raise ValueError("the index is laid out for four bits")
    lists = materialize(_posted(fps).mapInArrow(_pairs_of(limit), "a bigint, b bigint"), "simhash-links")
    crowded = lists.where("b IS NULL").select("a").distinct()
    return lists.where("b IS NOT NULL").unionByName(_stars(crowded))


def _posted(fps: DataFrame) -> DataFrame:
    """Every fingerprint under each choice of positions and the bytes it has there, sorted by list."""
    keys = []
    for n, places in enumerate(_POSITIONS):
        mask = sum(0xFF << 8 * p for p in places)
        keys.append(f"xxhash64({n}, fp & {mask - (1 << 64) if mask >> 63 else mask}L)")
    posted = fps.select("fp", F.posexplode(F.expr(f"array({', '.join(keys)})")).alias("choice", "key"))
    posted = posted.select("fp", F.col("choice").cast("short").alias("choice"), "key")
    return posted.repartition("key").sortWithinPartitions("key", "choice", "fp")


def _pairs_of(limit: int):
    """Read sorted lists as a stream: pairs of short lists, members of long ones with b null."""
    # For a set of agreeing byte positions (as bits): the choice made of its lowest ones, -1 below the minimum.
    places = [[p for p in range(8) if s >> p & 1] for s in range(256)]
    earliest = np.array([_POSITIONS.index(tuple(p[:8 - BITS])) if len(p) >= 8 - BITS else -1 for p in places])

    def forest(fp: np.ndarray, start: np.ndarray, size: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect, within each list, what its verified pairs connect. A pair counts where its first shared bytes are."""
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        own = np.repeat(start - first, size) + np.arange(size.sum())
        value, label = fp[own], np.arange(len(own))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for gap in range(1, int(size.max())):
            on = size > gap
            first, size, choice = first[on], size[on], choice[on]
            n = size - gap
            left = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            diff = value[left] ^ value[left + gap]
            near = np.flatnonzero(np.bitwise_count(diff) <= BITS)
            same = np.packbits(diff[near].view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
            near = near[earliest[same] == np.repeat(choice, n)[near]]
            found.append((left[near], left[near] + gap))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        while True:
            least = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if np.array_equal(old, label):
                break
        on = label != np.arange(len(label))
        return value[on], value[label[on]]

    def table(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key, choice = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowd = None  # key of a long list that is still being read
        for batch in _with_end(batches):
            if batch is not None:
                fp = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)])
                choice = np.concatenate([choice, batch.column(1).to_numpy().astype(np.int64)])
                key = np.concatenate([key, batch.column(2).to_numpy()])
            if not len(key):
                continue
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1]))))
            size = np.diff(np.append(cut, len(key)))
            # The last list may go on in the next batch: it waits, unless it is long already.
            open_end = batch is not None
            tail = int(cut[-1]) if open_end and size[-1] <= limit else len(key)
            long = size > limit
            if crowd is not None and (int(key[0]), int(choice[0])) == crowd:
                long[0] = True
            done = cut < tail
            whole = done & long
            for s, n in zip(cut[whole], size[whole], strict=True):
                yield table(fp[s:s + n], None)
            crowd = (int(key[-1]), int(choice[-1])) if open_end and (long[-1]) else None
            short = done & ~long
            for s, n, c in _portions(cut[short], size[short], choice[cut[short]]):
                a, b = forest(fp, s, n, c)
                if len(a):
                    yield table(a, b)
            if crowd is not None and tail < len(key):
                yield table(fp[tail:], None)
                tail = len(key)
            fp, key, choice = fp[tail:], key[tail:], choice[tail:]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _portions(start: np.ndarray, size: np.ndarray, choice: np.ndarray, room: int = 4_000_000):
    """Runs of lists whose comparisons fit the room; a list alone may exceed it."""
    on = size > 1
    start, size, choice = start[on], size[on], choice[on]
    total = np.cumsum(size * (size - 1) // 2)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, side="right")))
        yield start[at:stop], size[at:stop], choice[at:stop]
        at = stop


def _stars(crowded: DataFrame) -> DataFrame:
    """Links of fingerprints from long lists: those that share a value within half the distance link to the smallest."""
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [np.uint64(1) << np.uint64(i) for i in range(64)]
        flips = np.array([0, *one, *[a | b for a, b in combinations(one, 2)]], dtype=np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 64):
                some = fp[a:a + 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array((some[:, None] ^ flips).ravel().view(np.int64))], names=["a", "mid"])

    near = crowded.mapInArrow(around, "a bigint, mid bigint")
    ends = near.groupBy("mid").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b < top").drop("top")
    return near.join(ends, "mid").where("a <> b").select("a", "b").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """(fp, root, least): the group of every distinct fingerprint of ``docs`` (fp, __id), named by its smallest member."""
    nodes = docs.groupBy("fp").agg(F.min("__id").alias("least"))
    roots = components(links(nodes.select("fp")))
    groups = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(groups, "simhash-groups")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    A null or blank text has fingerprint zero and links like any other. Equal rows stay. A null doc_id gets the smallest
    id of its component, null if it holds none.
    """
    src = df.select(ref(doc_id).alias("__id"), ref(text).alias("__words"))
    docs = materialize(fingerprint(src, ["__id"], "__words"), "fingerprints")
    groups = _grouped(docs)
    # Groups of one need no join; the others take the smallest id of all members.
    lows = groups.where("root <> fp").groupBy("root").agg(F.min("least").alias("low"))
    tops = groups.where("root = fp").join(lows, "root").select("root", F.least("least", "low").alias("component_id"))
    named = groups.join(tops, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return docs.join(named, "fp").select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id (then by digest); all columns as they are.

    Rows equal in id and text count as one. Null ids come last. Only keys are shuffled where few rows go.
    """
    null = F.lit("\0null")
    names = [f"__c{i}" for i in range(len(df.columns))]
    at, words = (F.col(names[df.columns.index(c)]).cast("string") for c in (doc_id, text))
    rows = df.toDF(*names).withColumn("__key", F.md5(F.concat(F.coalesce(at, null), F.lit(":"), F.coalesce(words, null))))
    src = rows.select(F.col(names[df.columns.index(doc_id)]).alias("__id"), "__key", words.alias("__words"))
    docs = materialize(fingerprint(src, ["__id", "__key"], "__words"), "fingerprints")
    groups = _grouped(docs)
    keys = docs.groupBy("__id", "__key", "fp").agg(F.count("*").alias("n")).join(groups.select("fp", "root"), "fp")
    keys = materialize(keys.select("root", F.struct(F.col("__id").isNull().alias("last"), "__id", "__key").alias("who"), "n"), "simhash-keys")
    first = keys.groupBy("root").agg(F.min("who").alias("first"))
    told = keys.join(first, "root").where("who <> first OR n > 1").select(F.col("who.__key").alias("__key"), F.expr("who = first").alias("repeated")).distinct()
    marked = flagged(rows, materialize(told, "simhash-marks"), "__key")
    kept = marked.where("repeated IS NULL").select(*names).unionByName(marked.where("repeated").dropDuplicates(["__key"]).select(*names))
    return kept.toDF(*df.columns)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
