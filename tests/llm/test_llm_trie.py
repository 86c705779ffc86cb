"""The conversation trie against plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from prepspark.llm import trie
from prepspark.llm.catalog import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, key string"


def plain(rows):
    """Rows of the trie from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    for c in own:
        own[c] = [(r, t) for _, _, r, _, t in sorted(own[c])]
    members = {}
    ends = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children.get(p, ())) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children.get(p, ()))
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()) for p, m in members.items())


def told(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_query_equals_dictionaries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op11_conversation_trie"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("light,queue", [(1, 2), (7, 3), (1000, 1000)])
def test_shared_prefixes_shards_and_spills(spark, light, queue):
    """Few different turns, so that conversations share much; a third of them are equal."""
    rng = random.Random(5)
    rows = []
    for c in range(-45, 400):
        same = random.Random(1) if c % 3 == 0 else rng
        for k in range(same.randrange(1, 7)):
            rows.append((c, k, same.choice(["user", "assistant"]), same.choice(["a b", "a  c d", "", "é\x1cx y"]), 0, ""))
    got = trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(7), light, queue)
    assert told(got) == plain([r[:4] for r in rows])


def test_odd_tables(spark):
    rows = [
        (None, 0, "user", "lost"), (20, None, None, None), (20, 0, "user", "hi there"), (20, 0, "user", "hi there"), (20, 0, "agent", "hi"),
        (21, 5, "user", "x"), (23, 1, None, "y"), (23, None, "user", "z"), (47, 0, "user", "only"), (47, 0, "user", "alone"), (60, 1, "user", "w " * 300_000),
        *[(80, k, "user", f"long {k % 3}") for k in range(3000)], (81, 0, "user", "after"), (-3, 0, "u", "below"), (0, 0, "u", "zero"),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    assert told(trie.trie(df, 2, 50)) == plain(rows)
    assert trie.trie(df.limit(0)).count() == 0
    assert trie.trie(df.where("conv_id IS NULL")).count() == 0


def test_queue_spills_and_keeps_its_order():
    rng, q = random.Random(2), trie.SpillingQueue(8)
    sent = [(rng.randrange(5), rng.randrange(-3, 3), rng.randrange(3), 1, k, k) for k in range(500)]
    for m in sent:
        q.push(m)
    assert q.spills > 10 and len(q.heap) <= 8
    got = [list(q.receive(to)) for to in sorted({m[:3] for m in sent})]
    assert sorted(sum(got, [])) == sorted(sent) and not q.heap and not q.runs
