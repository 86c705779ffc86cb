"""Removal of repeated 400-byte strings by merging the Burrows-Wheeler transforms of shards.

Sorting every byte suffix is not feasible at corpus size, so the transforms run over phrases. The gram with the least hash
among ``SPREAD`` neighbouring ones is an anchor; a phrase reaches from one anchor to the next. Anchors depend on nearby bytes
alone, so two copies of a 400-byte string hold the same anchors and phrases, but for the edges. A shard is a run of documents:
its phrase suffixes are sorted once, and each sorted row knows the phrase before it and the row of that longer suffix.

The shards are merged by refinement. In round k an interval stands for the suffixes, of all shards, that agree in k phrases:
a range of rows in each shard. Every shard steps its ranges back by their preceding phrases; the pieces meet under (phrase,
interval), and those with two suffixes or more are the intervals of round k + 1, with a common prefix of k + 1 phrases. No
suffix is sorted again, and intervals of one suffix leave.

Anchors in repeated intervals are settled by bytes. Every 400-byte string starting within an anchor's reach holds its core
and lies in its surroundings. Equal surroundings elsewhere: all of them repeat. Equal cores but other surroundings: the
starts are cut in blocks of ``BLOCK``, which have a core and surroundings of their own, and where these leave it open the
strings are compared one by one, always once for each distinct surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import blocks, flagged, load, powers, query, ref
from prepspark.session import materialize

LENGTH = 400
SPREAD = 160
GRAM = 24
ROUNDS = 3
CORE = LENGTH - SPREAD + 1
BLOCK = 16
#: Bytes of text of a shard, and starts worked on at once in a long text.
SHARD_BYTES = 8_000_000
PART = 1_000_000
_NONE = 255


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text and the first start each is the least gram of; starts run over all grams windows."""
    starts = len(raw) - SPREAD - GRAM + 2
    found = []
    for s in range(0, max(starts, 0), PART):
        e = min(starts, s + PART)
        part = np.frombuffer(raw, np.uint8)[s:e + SPREAD + GRAM - 2]
        up, down = powers(1 << max(16, len(part).bit_length()))
        total = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)])))
        h = (total[GRAM:] - total[:-GRAM]) * down[:len(part) - GRAM + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= SPREAD:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < SPREAD:
            least = np.minimum(least[:len(least) - SPREAD + reach], least[SPREAD - reach:])
        found.append((least & np.uint64(0xFFFFFFFF)).astype(np.int64) + s)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(found)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return at[first], first


def describe(raw: bytes) -> tuple[np.ndarray, ...]:
    """Per anchor: phrase (0: none follows), core, surroundings (hashes), position, first start, number of starts (255: none), depth.

    The depth is the number of following phrases that every string of its starts is sure to hold, at most ROUNDS.
    """
    h, n = xxhash.xxh3_64_intdigest, len(raw)
    at, low = anchors(raw) if n >= LENGTH else (np.zeros(0, np.int64),) * 2
    p, q = at.tolist(), low.tolist()
    last = n - LENGTH
    phrase = [h(raw[a:b + GRAM]) | 1 for a, b in zip(p[:-1], p[1:], strict=True)] + [0] * bool(p)
    core = [h(raw[a:a + CORE]) if f <= last else 0 for a, f in zip(p, q, strict=True)]
    around = [h(raw[max(0, a - SPREAD + 1):a + LENGTH], min(a, SPREAD - 1)) if f <= last else 0 for a, f in zip(p, q, strict=True)]
    count = np.minimum(np.append(low[1:], len(raw)), last + 1) - low if p else low
    depth = np.searchsorted(low, low + LENGTH + 1 - SPREAD - GRAM, side="right") - 1 - np.arange(len(low))
    return (np.array(phrase, np.uint64), np.array(core, np.uint64), np.array(around, np.uint64), at.astype(np.int32), low.astype(np.int32),
            np.where(count > 0, count, _NONE).astype(np.uint8), np.minimum(depth, ROUNDS).astype(np.uint8))


_ARRAYS = (("phrase", "<u8"), ("core", "<u8"), ("around", "<u8"), ("at", "<i4"), ("low", "<i4"), ("starts", "u1"), ("depth", "u1"))


def shards(keyed: DataFrame) -> DataFrame:
    """Shards of (key, text) rows: keys and anchor counts of their documents, the anchors, and ``order``: suffixes by phrases.

    ``order`` is the sorted order by the first ROUNDS phrases, as deep as the refinement goes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1), SHARD_BYTES):
                made = [describe(t.encode("utf-8", "surrogatepass")) for t in texts]
                sizes = np.array([len(m[0]) for m in made], "<i4")
                if not sizes.any():
                    continue
                cells = [np.concatenate([m[k] for m in made]) for k in range(len(_ARRAYS))]
                keys = [batch.column(0)[start + k].as_py() for k in range(len(texts))]
                used = np.flatnonzero(sizes)
                name = xxhash.xxh3_64_intdigest(b"".join(keys)) >> 1
                order = _order(cells[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([b"".join([keys[k] for k in used])]), pa.array([sizes[used].tobytes()]), pa.array([order.astype("<i4").tobytes()]),
                     *[pa.array([c.astype(t).tobytes()]) for c, (_, t) in zip(cells, _ARRAYS, strict=True)]],
                    names=["shard", "keys", "sizes", "order", *[n for n, _ in _ARRAYS]])

    made = keyed.mapInArrow(run, "shard bigint, keys binary, sizes binary, order binary, " + ", ".join(f"{n} binary" for n, _ in _ARRAYS))
    # Equal runs of documents would share a name: the place in the table tells them apart.
    return materialize(made.withColumn("shard", F.xxhash64("shard", F.spark_partition_id(), F.monotonically_increasing_id())), "bwt-shards")


def _order(phrase: np.ndarray) -> np.ndarray:
    follow = [np.concatenate([phrase[k:], np.zeros(k, np.uint64)]) for k in range(ROUNDS)]
    for k in range(1, ROUNDS):
        follow[k] = np.where(follow[k - 1] == 0, np.uint64(0), follow[k])  # not beyond the end of a text
    return np.lexsort(follow[::-1])


def _step(symbol: np.ndarray, interval: np.ndarray) -> np.ndarray:
    """Name of the interval that follows from stepping back by a phrase."""
    h = (symbol ^ (interval * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Transform:
    """One shard: sorted rows, the phrase before each and the row of that longer suffix."""

    def __init__(self, phrase: bytes, order: bytes):
        self.phrase = np.frombuffer(phrase, "<u8")
        self.order = np.frombuffer(order, "<i4").astype(np.int64)
        self.row = np.empty(len(self.order), np.int64)
        self.row[self.order] = np.arange(len(self.order))
        before = self.order - 1
        self.symbol = np.where(before >= 0, self.phrase[before], np.uint64(0))  # 0: a text begins here
        self.back = np.where(self.symbol != 0, self.row[before], -1)

    def first(self) -> np.ndarray:
        """Interval of each row in round one; 0 for suffixes without a phrase."""
        return self.phrase[self.order]

    def refine(self, interval: np.ndarray) -> np.ndarray:
        """Intervals of the next round from those of this one (0: no more)."""
        out = np.zeros(len(interval), np.uint64)
        on = np.flatnonzero((interval != 0) & (self.back >= 0))
        out[self.back[on]] = _step(self.symbol[on], interval[on]) | np.uint64(1)
        return out

    def rounds(self, live: list[np.ndarray]) -> list[np.ndarray]:
        """Intervals of every row, a round at a time, each after its repeated intervals are known."""
        out = [self.first()]
        for names in live:
            now = np.where(_among(out[-1], names), out[-1], np.uint64(0))
            out[-1] = now
            out.append(self.refine(now))
        return out


def _among(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return (names[at] == values) & (values != 0)


def _pieces(interval: np.ndarray, shard: int) -> pa.Table:
    """(interval, shard, n) of the ranges of a shard; equal names lie side by side in sorted order."""
    interval = interval[interval != 0]
    cut = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1]))) if len(interval) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(interval)))
    return pa.table({"interval": pa.array(interval[cut].view(np.int64)), "shard": pa.array(np.full(len(cut), shard, np.int64)), "n": pa.array(n.astype(np.int32))})


def _repeated(pieces: DataFrame) -> DataFrame:
    """(interval, shard) of the intervals with two suffixes or more over all shards: one shuffle, read as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, n, whole = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _ended(batches):
            if batch is not None:
                name, shard, n = (np.concatenate([a, batch.column(k).to_numpy()]) for k, a in enumerate((name, shard, n)))
            if not len(name):
                continue
            cut = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            total = np.add.reduceat(n, cut)
            if whole == name[0]:
                total[0] += 2
            keep = np.repeat(total >= 2, np.diff(np.append(cut, len(name))))
            # A last interval of one suffix waits for the next batch.
            end = len(name) if batch is None or total[-1] >= 2 else int(cut[-1])
            whole = name[-1] if total[-1] >= 2 else None
            on = np.flatnonzero(keep[:end])
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(shard[on])], names=["interval", "shard"])
            name, shard, n = name[end:], shard[end:], n[end:]

    return pieces.repartition("interval").sortWithinPartitions("interval").mapInArrow(run, "interval bigint, shard bigint")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _live(table, rounds: int) -> list[np.ndarray]:
    """Names of the repeated intervals of each round, ascending; a group without rows has no columns either."""
    if not table.num_rows:
        return [np.zeros(0, np.uint64)] * rounds
    names, which = table["interval"].to_numpy().view(np.uint64), table["round"].to_numpy()
    return [np.unique(names[which == k]) for k in range(1, rounds + 1)]


def _back(k: int):
    """Step from round ``k`` to the next inside a shard."""
    def run(left, right):
        names = _live(right, k)
        empty = pa.table({"interval": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        return pa.concat_tables([empty, *[
            _pieces(Transform(p.as_py(), o.as_py()).rounds(names)[-1], s.as_py())
            for s, p, o in (zip(left["shard"], left["phrase"], left["order"], strict=True) if left.num_rows else ())]])

    return run


def intervals(table: DataFrame) -> DataFrame:
    """(interval, shard, round): the repeated intervals of every round, by shard."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, phrase, order = (batch.column(c)[k].as_py() for c in range(3))
                yield from _pieces(Transform(phrase, order).first(), shard).to_batches()

    narrow = table.select("shard", "phrase", "order")
    shape = "interval bigint, shard bigint, n int"
    known = materialize(_repeated(narrow.mapInArrow(start, shape)).withColumn("round", F.lit(1)), "bwt-intervals")
    for k in range(1, ROUNDS):
        pieces = narrow.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_back(k), shape)
        more = materialize(_repeated(pieces).withColumn("round", F.lit(k + 1)), "bwt-intervals")
        known = known.unionByName(more)
    return known


def candidates(table: DataFrame, known: DataFrame) -> DataFrame:
    """(core, around, key, at, low, starts, n) of the anchors in repeated intervals as deep as they are sure to go; n: equal rows in the shard."""
    names = ["core", "around", "key", "at", "low", "starts", "n"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def pick(left, right):
        made = []
        live = _live(right, ROUNDS)
        for row in left.to_pylist() if left.num_rows else []:
            t = Transform(row["phrase"], row["order"])
            cells = {n: np.frombuffer(row[n], kind) for n, kind in _ARRAYS}
            by_round = t.rounds(live)[:ROUNDS]
            on = np.zeros(len(t.row), bool)
            for k in range(ROUNDS):
                on |= (cells["depth"] == k + 1) & (by_round[k][t.row] != 0)
            on = np.flatnonzero(on & (cells["starts"] != _NONE))
            keys = np.frombuffer(row["keys"], "S1").reshape(-1, 16)
            doc = np.repeat(np.arange(len(keys)), np.frombuffer(row["sizes"], "<i4"))[on]
            key = np.frombuffer(row["keys"], "V16")[doc]
            made.append(pa.table([pa.array(cells["core"][on].view(np.int64)), pa.array(cells["around"][on].view(np.int64)), pa.array(key.tolist(), pa.binary()),
                                  pa.array(cells["at"][on]), pa.array(cells["low"][on]), pa.array(cells["starts"][on].astype(np.int32)), pa.array(np.ones(len(on), np.int64))], names=names))
        if not made:
            return pa.table([pa.array([], t) for t in types], names=names)
        out = pa.concat_tables(made).group_by(names[:-1]).aggregate([("n", "sum")]).rename_columns([*names[:-1], "n"])
        return out.select(names)

    shape = "core bigint, around bigint, key binary, at int, low int, starts int, n bigint"
    return table.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(pick, shape)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(batch, row) of the first row of every id in a task: copies of a text have its id, and what they hold is counted already."""
    seen: set[int] = set()
    for batch in batches:
        for k, row in enumerate(batch.column(0).to_pylist()):
            if row not in seen:
                seen.add(row)
                yield batch, k


def _blocks(texts: DataFrame) -> DataFrame:
    """(core, around, id, low, starts, n) of the blocks of starts of the listed anchors of (id, text, spots), counted from the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch, k in _once(batches):
            raw, row = batch.column(1)[k].as_py().encode("utf-8", "surrogatepass"), batch.column(0)[k].as_py()
            out: list[tuple] = []
            for at, low, starts, n in np.frombuffer(batch.column(2)[k].as_py(), "<i4").reshape(-1, 4).tolist():
                last = low + starts - 1
                for top in range(at - (at - last) // BLOCK * BLOCK, low - 1, -BLOCK):
                    bottom = top - BLOCK + 1
                    first, end = max(0, bottom), min(len(raw), top + LENGTH)
                    a, b = max(low, bottom), min(last, top)
                    out.append((h(raw[top:bottom + LENGTH]), h(raw[first:end], top - first), a, b - a + 1, n))
            for i in range(0, len(out), 20_000):
                some = list(zip(*out[i:i + 20_000], strict=True))
                hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in some[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, pa.array([row] * len(some[0]), pa.int64()), pa.array(some[2], pa.int32()), pa.array(some[3], pa.int32()), pa.array(some[4], pa.int64())],
                    names=["core", "around", "id", "low", "starts", "n"])

    return texts.select("id", "text", "spots").mapInArrow(run, "core bigint, around bigint, id bigint, low int, starts int, n bigint")


def _strings(texts: DataFrame) -> DataFrame:
    """(h, id, start, n): every string of the listed blocks of (id, text, spots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch, k in _once(batches):
            raw = batch.column(1)[k].as_py().encode("utf-8", "surrogatepass")
            row = batch.column(0)[k].as_py()
            spots = np.frombuffer(batch.column(2)[k].as_py(), "<i4").reshape(-1, 3).astype(np.int64)
            for a in range(0, len(spots), 1000):
                some = spots[a:a + 1000]
                start = np.concatenate([np.arange(low, low + n) for low, n, _ in some.tolist()])
                names = np.array([h(raw[i:i + LENGTH]) for i in start.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array([row] * len(start), pa.int64()), pa.array(start.astype(np.int32)),
                     pa.array(np.repeat(some[:, 2], some[:, 1]))], names=["h", "id", "start", "n"])

    return texts.select("id", "text", "spots").mapInArrow(run, "h bigint, id bigint, start int, n bigint")


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of the union of intervals; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1]))) if len(starts) else np.zeros(0, np.int64)
    return np.stack([starts[cut], ends[np.append(cut[1:], len(starts)) - 1] if len(starts) else ends], axis=1)


def _packed(rows: DataFrame, by: str, columns: list[str], name: str) -> DataFrame:
    """One row per ``by`` with the numbers of its rows as 32-bit tuples; there are at most the rows of one text."""
    kind = rows.schema[by].dataType.simpleString()
    type_ = pa.binary() if kind == "binary" else pa.int64()

    def run(key, table):
        cells = np.stack([table[c].to_numpy().astype("<i4") for c in columns], axis=1)
        return pa.table({by: pa.array([key[0].as_py()], type_), name: pa.array([cells.tobytes()], pa.binary())})

    return rows.select(by, *columns).groupBy(by).applyInArrow(run, f"{by} {kind}, {name} binary")


def _settle(found: DataFrame, who: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Of (core, around, n) rows with members ``who``: members whose surroundings occur twice, and one of each surroundings where a core has several (with the total n).

    Copies and passages shared as they stand are one group here: sums combine before the shuffle.
    """
    groups = found.groupBy("core", "around").agg(F.sum("n").alias("total"), F.min(F.struct(*who)).alias("one"))
    groups = materialize(groups, name)
    twice = groups.where("total >= 2").select("core", "around")
    # Copies of a text, in several shards or tasks, name the same members.
    whole = found.select("core", "around", *who).join(twice, ["core", "around"]).select(*who).distinct()
    several = groups.groupBy("core").agg(F.min("around").alias("a"), F.max("around").alias("b")).where("a < b").select("core")
    # A core of many near copies has many groups: a join of two tables, unlike one above an aggregation, is split among tasks.
    several = materialize(several, f"{name}-several")
    return whole, groups.join(several, "core").select("one.*", F.least("total", F.lit(2)).alias("n"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, runs): per text (key: md5) with a repeated 400-byte string the runs of bytes that such strings cover.

    ``docs`` has key and text, a row per document; equal texts repeat each other. ``runs`` holds 32-bit pairs.
    """
    table = shards(docs.where(f"octet_length(text) >= {LENGTH}").select("key", "text"))
    found = materialize(candidates(table, intervals(table)), "bwt-candidates")
    whole, open_ = _settle(found, ["key", "at", "low", "starts"], "bwt-groups")
    spots = materialize(_packed(open_, "key", ["at", "low", "starts", "n"], "spots").withColumn("id", F.monotonically_increasing_id()), "bwt-spots")
    near = flagged(docs, spots, "key").where("spots IS NOT NULL")
    blocks_ = materialize(_blocks(near), "bwt-blocks")
    more, open_ = _settle(blocks_, ["id", "low", "starts"], "bwt-block-groups")
    last = materialize(_packed(open_, "id", ["low", "starts", "n"], "spots").join(spots.select("id", "key"), "id"), "bwt-strings")
    strings = materialize(_strings(flagged(docs, last, "key").where("spots IS NOT NULL")), "bwt-string-hashes")
    again = materialize(strings.groupBy("h").agg(F.sum("n").alias("total")).where("total >= 2").select("h"), "bwt-again")
    exact = strings.join(again, "h").select("id", F.col("start").alias("low"), F.lit(1).alias("starts")).distinct()
    settled = _packed(more.unionByName(exact), "id", ["low", "starts"], "cells").join(spots.select("id", "key"), "id").select("key", "cells")
    covered = settled.unionByName(_packed(whole, "key", ["low", "starts"], "cells"))

    def cover(key, rows):
        low, starts = np.frombuffer(b"".join(rows["cells"].to_pylist()), "<i4").reshape(-1, 2).astype(np.int64).T
        return pa.table({"key": pa.array([key[0].as_py()], pa.binary()), "runs": pa.array([_runs(low, low + starts - 1 + LENGTH).astype("<i4").tobytes()], pa.binary())})

    return materialize(covered.groupBy("key").applyInArrow(cover, "key binary, runs binary"), "bwt-runs")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``kept`` also the remaining bytes.

    A null text counts as empty. Texts below 400 bytes lose nothing. Equal rows repeat each other, so equal texts of 400 bytes or
    more vanish. Matches do not cross documents.
    """
    words = F.coalesce(ref(text).cast("string"), F.lit(""))
    rows = df.select(ref(doc_id).alias("doc_id"), F.unhex(F.md5(words)).alias("key"), words.alias("text"))
    joined = flagged(rows, repeated_spans(rows.select("key", "text")), "key").select("doc_id", "text", "runs")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                made = [_cut(t.encode("utf-8", "surrogatepass"), batch.column(2)[start + k].as_py()) for k, t in enumerate(texts)]
                cells = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *cells[:4 + kept]],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept)


def _cut(raw: bytes, runs: bytes | None) -> tuple[int, int, int, str, bytes]:
    spans = np.frombuffer(runs, "<i4").reshape(-1, 2).tolist() if runs else []
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    rest = b"".join([*parts, raw[at:]]) if spans else raw
    return len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))
