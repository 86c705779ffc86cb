"""Secret scans against unanchored patterns over whole texts, and tokens with their checksums."""

import binascii
import hashlib
import random
import re

import pytest

from prepspark.llm import secrets
from prepspark.llm.catalog import QUERIES

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(s for _, _, s in sorted(out))


def base_of(text):
    return secrets.told([s for s in secrets.scan(text) if s[0] in secrets.BASE])


def test_base_spans_equal_patterns_over_whole_texts():
    rng = random.Random(3)
    words = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "apikey", "AKIA", "AKIAAKIA", "=", ":", " ", "  ", "\"", "'", "\n", "é", "ſ",
             "K", "İ", "abc", "12345678", "deadbeef" * 3, "deadbeef" * 4, "f" * 31, "0" * 70, "XYZ123XYZ123", "x", "_", "-", "token=token=12345678"]
    for _ in range(4000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        assert base_of(text) == plain(text), text


def test_hex_runs_at_every_place_and_length():
    for before in range(20):
        for n in (30, 31, 32, 33, 40, 64, 65):
            text = "g" * before + "a1" * (n // 2) + "b" * (n % 2) + "!" + "0" * 33
            assert base_of(text) == plain(text)


def test_query_equals_patterns(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_secret_scan"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kept = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE)
        assert kept == want and r.n_hex == want.count("hex:") and r.n_access == want.count("access:") and r.n_assign == want.count("assign:")


def sealed(prefix, body):
    """A token whose last six characters are the base-62 CRC-32 of its body."""
    n, digits = binascii.crc32(body.encode()) & 0xFFFFFFFF, []
    while n:
        digits.append((list(map(str, range(10))) + [chr(c) for c in range(65, 91)] + [chr(c) for c in range(97, 123)])[n % 62])
        n //= 62
    return prefix + body + "".join(reversed(digits)).rjust(6, "0")


def extended_key(payload):
    raw = bytes.fromhex("0488ade4") + payload
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = secrets.BASE58[r] + out
    return out


@pytest.mark.parametrize("prefix,kind", [("ghp_", "github"), ("gho_", "github"), ("ghr_", "github"), ("npm_", "npm")])
def test_sealed_tokens_are_added_only_with_their_checksum(prefix, kind):
    token = sealed(prefix, "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    text = f"é use {token}, twice"
    assert secrets.scan(text) == [(kind, 6, 6 + len(token))]
    broken = token[:-1] + ("0" if token[-1] != "0" else "1")
    assert secrets.scan(f"use {broken}") == [] and secrets.scan(f"use {token}x") == [] and secrets.scan(f"x{token}") == []
    assert secrets.scan(f"token={token}") == [("assign", 0, 6 + len(token)), (kind, 6, 6 + len(token))]


def test_extended_private_keys():
    key = extended_key(bytes(range(74)))
    assert key.startswith("xprv") and len(key) == 111
    assert secrets.scan(f"key {key}.") == [("xprv", 4, 115)]
    assert secrets.scan(f"key {key[:-1]}{'1' if key[-1] != '1' else '2'}.") == []


def test_odd_tables(spark):
    long = "ab " * 400_000 + "password=" + "x" * 9 + " " + "e" * 32
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "secret: 'abcdefgh'", None), (3, long, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id or 0, r.spans) for r in secrets.detect(df, ["doc_id"]).collect())
    assert got == [(0, ""), (1, ""), (1, ""), (2, "assign:0:17"), (3, f"assign:1200000:1200018,hex:1200019:1200051")]
    assert secrets.detect(df.limit(0), ["doc_id"]).count() == 0
