"""Benchmark decontamination by spaced-seed hashing.

A text leaks a benchmark item if ``SPAN`` consecutive tokens of it equal ``SPAN`` tokens of the item but for at most
``SUBSTITUTIONS``. The span is cut in five blocks; each of the ten fixed masks ignores two of them, so two substitutions
always leave one mask intact. Hashes of all masks at all positions of the texts are held against a bit table of the
benchmark's hashes (fixed size, two bits a hash), what passes is joined with them, and the windows around the hits are
compared token by token. Items of 5 to 12 tokens must occur as they are; shorter ones are no evidence and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import blocks, flagged, load, powers, query, ref
from prepspark.session import materialize

SPAN = 13
SUBSTITUTIONS = 2
SIZES = (3, 3, 3, 2, 2)
LEAST = 5
#: Bits of the table that is sent to every task (2 MB).
TABLE_BITS = 24
# Odd multipliers of the hashes.
_MULT = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
_OUTSIDE = regex.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULT[0])
    return h ^ (h >> np.uint64(29))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (lower-cased run of letters and digits) of the texts, and the number of its text."""
    parts = []
    for t in texts:
        t = t.lower()
        parts.append((_OUTSIDE.sub(" ", t) if _OUTSIDE.search(t) else t).encode("utf-8", "surrogatepass"))
    raw = np.frombuffer(b" ".join([*parts, b" "]), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    inside = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]
    size = 1 << max(16, int(len(raw) - 1).bit_length())
    up, down = powers(size)
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return _mix((total[stop - 1] - before) * down[start]), np.searchsorted(ends, start, side="right")


def seeds(h: np.ndarray, text: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(span, first tokens, hashes) for every mask at every place where its span lies within one text."""
    def run(at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            out = (out + h[at + k]) * np.uint64(_MULT[1])
        return out ^ (out >> np.uint64(32))

    at = _starts(text, SPAN)
    if len(at):
        offset = np.cumsum((0, *SIZES))
        grams = {size: run(np.arange(len(h) - size + 1), size) for size in set(SIZES)}
        part = [grams[size][at + o] for size, o in zip(SIZES, offset, strict=False)]
        for n, chosen in enumerate(combinations(range(len(SIZES)), len(SIZES) - SUBSTITUTIONS)):
            key = np.full(len(at), n + 1, dtype=np.uint64)
            for k, c in enumerate(chosen):
                key = (key ^ part[c]) * np.uint64(_MULT[2 + k])
            yield SPAN, at, _mix(key)
    for size in short:
        at = _starts(text, size)
        if len(at):
            yield size, at, _mix(run(at, size) + np.uint64(100 + size))


def _starts(text: np.ndarray, size: int) -> np.ndarray:
    if len(text) < size:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(text[size - 1:] == text[:len(text) - size + 1])


def _windows(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Token hashes of windows, as lists of SPAN numbers filled up with zeros."""
    cells = np.where(np.arange(SPAN) < size[:, None], h[np.minimum(at[:, None] + np.arange(SPAN), len(h) - 1)], np.uint64(0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * SPAN), pa.array(cells.ravel().view(np.int64)))


def _probe(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _scan(keyed: DataFrame, kind: str, short, table, bits: int) -> DataFrame:
    """(key, seed, window) of the places of ``keyed`` (key, text) whose seed is in the table; all places without one.

    ``short`` maps nothing for texts (a list of sizes); for items (None) each shorter than SPAN gives one place of its own size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = None if table is None else table.value
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                h, text = tokens(texts)
                if short is None:
                    count = np.bincount(text, minlength=len(texts))
                    sizes = tuple(int(n) for n in np.unique(count) if LEAST <= n < SPAN)
                else:
                    sizes = short
                for size, at, seed in seeds(h, text, sizes):
                    if short is None and size < SPAN:
                        on = count[text[at]] == size
                        at, seed = at[on], seed[on]
                    if filled is not None:
                        one, two = _probe(seed, bits)
                        on = np.flatnonzero(filled[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                        on = on[(filled[two[on] >> 3] >> (two[on] & 7).astype(np.uint8) & 1) != 0]
                        at, seed = at[on], seed[on]
                    if len(at):
                        keys = batch.column(0).take(pa.array(start + text[at]))
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(seed.view(np.int64)), _windows(h, at, np.full(len(at), size))], names=["key", "seed", "window"])

    return keyed.mapInArrow(run, f"key {kind}, seed bigint, window array<bigint>")


def _table(seen: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the seeds: at most 2 ** bits / 64 rows reach the driver, however many seeds there are."""
    low = (1 << bits) - 1
    places = seen.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit(low).cast("bigint")))).alias("p"))
    words = places.groupBy((F.shiftright("p", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << bits >> 6, dtype=np.int64)
    for w, b in words.toLocalIterator():
        out[w] = b
    return out.view(np.uint8)


def leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", bits: int = TABLE_BITS) -> DataFrame:
    """(key, item_id, matched, n_windows): per leaking text (key: md5) the smallest item, most equal tokens, leaking windows.

    Null and blank texts leak nothing; an empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    named = items.select(F.struct(ref(item_id).cast("string").alias("s"), ref(item_id).alias("i")).alias("key"), ref(text).cast("string").alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    known = _scan(named, kind, None, None, bits).groupBy("seed", "window").agg(F.min("key.i").alias("item_id"))
    known = materialize(known, "benchmark-seeds")
    sizes = known.select(F.size(F.filter("window", lambda x: x != 0)).alias("n")).where(f"n < {SPAN}").distinct().collect()
    table = spark.sparkContext.broadcast(_table(known, bits))
    keyed = docs.select(F.md5(ref(text).cast("string")).alias("key"), ref(text).cast("string").alias("text")).where("text IS NOT NULL")
    hits = _scan(keyed, "string", tuple(sorted(r.n for r in sizes)), table, bits)
    same = "size(filter(sequence(0, 12), k -> window[k] = other[k]))"
    pairs = hits.join(known.withColumnRenamed("window", "other"), "seed").withColumn("matched", F.expr(same))
    found = pairs.where(f"matched >= {SPAN - SUBSTITUTIONS}").withColumn("matched", F.col("matched") - F.size(F.filter("window", lambda x: x == 0)))
    return found.groupBy("key").agg(F.min("item_id").alias("item_id"), F.max("matched").cast("bigint").alias("matched"),
                                    F.count_distinct("window").alias("n_windows"))


def contamination(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, contaminated, item_id (smallest that leaks, else null), matched and n_windows (0 without a leak) of every row.

    Equal rows stay, null keys are kept; equal texts share a verdict.
    """
    found = materialize(leaks(df.select(ref(text).alias("text")), items.select(ref(item_id).alias("item_id"), ref(item_text).alias("text"))), "leaks")
    rows = df.select(ref(doc_id).alias("doc_id"), F.md5(ref(text).cast("string")).alias("key"))
    return flagged(rows, found, "key").select(
        "doc_id", F.col("matched").isNotNull().alias("contaminated"), "item_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("matched", "n_windows")])


def clean(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text leaks no item, all columns as they are."""
    found = materialize(leaks(df.select(ref(text).alias("text")), items).select("key"), "leaks")
    names = [f"__c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names).withColumn("key", F.md5(F.col(names[df.columns.index(text)]).cast("string")))
    return flagged(rows, found.withColumn("bad", F.lit(True)), "key").where("bad IS NULL").select(*names).toDF(*df.columns)


def _sql() -> str:
    cuts = [0, *np.cumsum(SIZES).tolist()]
    keys = []
    for chosen in combinations(range(5), 3):
        parts = " || ' ' || ".join(f"array_to_string(w[{cuts[c] + 1}:{cuts[c + 1]}], ' ')" for c in chosen)
        keys.append(f"'{''.join(map(str, chosen))} ' || {parts}")
    grams = lambda t, k: f"SELECT {k}, toks[i:i + 12] AS w FROM (SELECT {k}, toks, unnest(range(1, len(toks) - 11)) AS i FROM {t})"
    toks = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{1fff}]+') AS toks"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {toks} FROM documents), b AS (SELECT item_id, {toks} FROM benchmark),
dk AS (SELECT rid, w, unnest([{', '.join(keys)}]) AS k FROM ({grams('d', 'rid')})),
bk AS (SELECT item_id, w, unnest([{', '.join(keys)}]) AS k FROM ({grams('b', 'item_id')})),
p AS (SELECT rid, item_id, dk.w, len(list_filter(range(1, 14), lambda k: dk.w[k] = bk.w[k])) AS matched FROM dk JOIN bk USING (k)),
f AS (SELECT rid, min(item_id) AS item_id, max(matched)::BIGINT AS matched, count(DISTINCT w)::BIGINT AS n_windows FROM p WHERE matched >= 11 GROUP BY rid)
SELECT doc_id, f.rid IS NOT NULL AS contaminated, item_id, coalesce(matched, 0)::BIGINT AS matched, coalesce(n_windows, 0)::BIGINT AS n_windows
FROM d LEFT JOIN f USING (rid)
"""


@query("op8_decontamination", _sql())
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
