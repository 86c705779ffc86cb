"""The filter audit against a replay of every order over every document."""

import itertools
import re

from prepspark.llm import interactions
from prepspark.llm.catalog import QUERIES


def replay(docs, labels):
    """Rows of the audit from (doc_id, text, source) and (doc_id, quality, toxic), document by document."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t) is not None,
            i is not None and smallest[t] < i), strict=True) if bad}
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for f in "ABCDE":
            total = sum(out[part, "".join(o), o.index(f) + 1][1] for o in itertools.permutations("ABCDE"))
            for o in itertools.permutations("ABCDE"):
                out[part, "".join(o), o.index(f) + 1].append(total)
    return out


def told(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_query_equals_replay(spark, sf):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    want = replay(read("documents", "doc_id", "text", "source"), read("labels", "doc_id", "quality", "toxic"))
    assert told(QUERIES["op12_filter_audit"](spark, sf)) == want


def test_intervals_partition_the_orders():
    """Every mask but the empty one is removed exactly once in every order."""
    for mask in range(32):
        ranks = sorted(r for m, _, lo, hi in interactions.intervals() if m == mask for r in range(lo, hi))
        assert ranks == (list(range(120)) if mask else [])


def test_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = [(5, text, "a"), (7, text, None), (7, text, "b"), (7, text, "b"), (None, text, "a"), (None, None, ""), (3, "", "c"), (4, None, "c"),
            (9, text + " #", "a"), (10, "A" * 100, "c"), (11, "x " * 200_000, "a"), (5, text, "b"), (12, "\x1c" * 3, "a")]
    labels = [(7, 1, 0), (7, 1, None), (5, None, 1), (None, 1, 1), (3, 0, 0), (99, 1, 1)]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], "doc_id bigint, text string, source string, n bigint, mask string")
    got = interactions.masks(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert told(interactions.audit(got)) == replay(docs, labels)
    none = interactions.masks(df.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert interactions.audit(none).count() == 0
