"""Near-duplicates, decontamination, repeated strings and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prepspark.llm import decontaminate, simhash, substrings
from prepspark.llm.components import components
from prepspark.session import materialize

SHAPE = "doc_id bigint, text string"


def union_find(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


# ---- components

def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 4)], "a bigint, b bigint")).collect()}
    root = union_find(3500, pairs)
    by = {}
    for i, r in enumerate(root):
        by.setdefault(r, []).append(i)
    for group in by.values():
        if len(group) > 1:
            assert {got[i] for i in group} == {min(group)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- SimHash

def plain_duplicates(rows):
    fps = [int(x) for x in simhash.fingerprints([t or "" for _, t in rows])]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{fp:016x}", least.get(r)) for (d, _), fp, r in zip(rows, fps, root)]


def test_fingerprint_by_hand():
    import xxhash

    words = "A b C d e".split()
    grams = [" ".join(w.lower() for w in words[i:i + 4]) for i in range(2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    assert int(simhash.fingerprints(["A b\tC  d e"])[0]) == hs[0] & hs[1]
    assert int(simhash.fingerprints(["É Two"])[0]) == xxhash.xxh64_intdigest("É two".encode(), 42)
    assert list(simhash.fingerprints(["", " \x0b\n"])) == [0, 0]


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.randint(150, 400))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 140):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (499, " "), (None, base[0]), (3, base[3]), (3, base[4]), (600, "one two"), (None, "lonely words stand here")]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("own") for c in ("fp", "root", "least", "node")})
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(plain_duplicates(rows), key=repr)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    fps = simhash.fingerprints([t or "" for _, t in rows])
    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 4])
    assert kept.count() == len(set(roots)) and kept.select("text").distinct().count() == kept.count()
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [2048, 40, 2])
def test_long_lists_lose_no_link(spark, limit):
    rng = random.Random(limit)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(120):
            y = x
            for _ in range(rng.randrange(7)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    u = np.array(sorted(fps), dtype=np.uint64)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp bigint"), limit=limit)).collect()}
    root = union_find(len(u), [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4)])
    mine, theirs = {}, {}
    for i, x in enumerate(u.view(np.int64).tolist()):
        mine.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(root[i], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


# ---- decontamination

def test_leaks_survive_two_substitutions(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(500))
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 40)))) for i in range(20)] + [(50, "just six tokens in this item"), (51, "too short"), (52, None), (None, "")]
    noise = lambda n: " ".join("n" + str(rng.randrange(900)) for _ in range(n))
    docs, want = [], {}
    for i in range(200):
        j = rng.randrange(20)
        w = items[j][1].split()
        k = rng.choice([0, 1, 2, 3])
        a = rng.randrange(len(w) - 12)
        span = w[a:a + 13]
        for at in rng.sample(range(13), k):
            span[at] = "changed"
        docs.append((i, noise(30) + ", " + " ".join(x.upper() if rng.random() < 0.2 else x for x in span) + ". " + noise(20)))
        want[i] = k <= 2
    docs += [(300, "x just six  tokens, in this ITEM y"), (301, "just six tokens in that item"), (302, "too short"), (303, None), (304, ""), (None, items[0][1]), (305, items[0][1]), (305, items[0][1])]
    want |= {300: True, 301: False, 302: False, 303: False, 304: False, None: True, 305: True}
    df = spark.createDataFrame(docs, SHAPE).withColumns({c: F.lit("own") for c in ("key", "seed", "window", "item_id", "bad")})
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.contaminated for r in got} == want
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == sum(not want[d] for d, _ in docs)
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_bit_table_size_never_decides(spark, table):
    docs, bench = table("documents"), table("benchmark")
    a = {tuple(r) for r in decontaminate.leaks(docs.select("text"), bench).collect()}
    assert a and a == {tuple(r) for r in decontaminate.leaks(docs.select("text"), bench, bits=8).collect()}


# ---- repeated strings

def plain_removal(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i:i + 400] for _, b in raws for i in range(len(b) - 399))
    out = []
    for d, b in raws:
        cover = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 399):
            if count[b[i:i + 400]] > 1:
                cover[i:i + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[:-1]])
        out.append((d, len(b), len(b) - len(kept), int((cover[1:] < cover[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_removal_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [para(rng.randint(60, 250)) for _ in range(10)]
    rows = [(i, " ".join(rng.choice(base) if rng.random() < 0.3 else para(rng.randint(5, 100)) for _ in range(rng.randint(1, 4)))) for i in range(80)]
    for i in range(80, 140):
        t = rng.choice(rows)[1]
        p = rng.randrange(max(1, len(t)))
        t = t[:p] + rng.choice(["X", "", "YY "]) + t[p + rng.randint(0, 3):]
        a = rng.randrange(max(1, len(t)))
        rows.append((i, t[a:a + rng.randint(350, 900)] if rng.random() < 0.5 else t))
    rows += [(300, None), (301, ""), (302, "a" * 399), (303, "b" * 400), (304, "c" * 401), (305, "ab" * 500), (None, rows[3][1]), (307, rows[3][1]), (307, rows[3][1])]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("own") for c in ("key", "runs", "core", "n")})
    assert sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=repr) == plain_removal(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(df, kept=True).collect()}
    assert kept[302] == b"a" * 399 and kept[304] == b""


def test_a_core_of_many_near_copies_is_split_among_tasks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("core"), F.xxhash64("id").alias("around"), F.col("id").alias("who"), F.lit(1).cast("bigint").alias("n"))
    found = rows.unionByName(rows.where("who >= 29000").withColumn("around", F.lit(5).cast("bigint"))).unionByName(rows.where("who % 100 = 0").withColumn("who", F.col("who") + 100_000))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        whole, open_ = substrings._settle(found, ["who"], "test-groups")
        got = sorted(tuple(r) for r in open_.collect())
        assert "skew=true" in open_._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    twice = {i for i in range(30_000) if i % 100 == 0}
    assert sorted(r.who for r in whole.collect()) == sorted([*twice, *(i + 100_000 for i in twice)])
    several = [i for i in range(30_000) if i < 10_000 or i >= 29_000]
    assert got == sorted([*((i, 2 if i in twice else 1) for i in several), *((i, 1) for i in range(29_000, 30_000))])


def test_copies_of_a_text_are_packed_once(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(n))
    text = words(400)
    near = [text[:p] + "X" + text[p:] for p in range(300, 2000, 97)]
    rows = [(i, t) for i, t in enumerate([text, *near] + [text] * 30 + [words(50) for _ in range(20)])]
    plain, most = substrings._packed, []

    def packed(found, by, columns, name):
        most.append(found.groupBy(by, *columns).count().agg(F.max("count")).first()[0])
        return plain(found, by, columns, name)

    monkeypatch.setattr(substrings, "_packed", packed)
    got = substrings.remove_repeats(spark.createDataFrame(rows, SHAPE).repartition(8)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal(rows)
    assert len(most) == 4 and set(most) == {1}


def test_anchors_follow_the_bytes_alone():
    rng = np.random.default_rng(2)
    middle = rng.integers(97, 123, 3000, dtype=np.uint8).tobytes()
    a, _ = substrings.anchors(b"x" * 500 + middle + b"y" * 300)
    b, _ = substrings.anchors(rng.integers(97, 123, 777, dtype=np.uint8).tobytes() + middle)
    inner = lambda at, start: {int(x) - start for x in at if start + 200 <= x <= start + 2600}
    assert inner(a, 500) == inner(b, 777)


# ---- pipeline

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    blank = docs.limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit("123 456").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(blank)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] == sizes[0] - 1 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert docs.where("text RLIKE '@[a-z0-9]+[.]example'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == sizes[-1] and out.where("n_tokens <> size(ids)").count() == 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run_equals_the_stages(spark, sf):
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and {"doc_id", "ids", "ids_sha256"} <= set(whole.columns)
