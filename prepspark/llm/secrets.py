"""Secrets: keyword prefilter, anchored patterns near the hits, embedded checksums.

One Aho-Corasick automaton reads the ASCII-lowered text once. A pattern is tried only where one of its keywords starts, anchored
there, in the order of the text, never inside the match before it: that is the leftmost non-overlapping search of the pattern
over the whole text. Runs of hexadecimal digits hold no keyword; a run of 32 covers four neighbours among every eighth
character, so only such places are looked at. Tokens that carry a checksum of themselves are added where it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prepspark.llm.common import load, map_text, query

BASE = ("assign", "access", "hex")
#: Kinds that are added: a checksum inside the token must hold.
CHECKED = ("github", "npm", "xprv")
KINDS = (*BASE, *CHECKED)

# Keywords, lower-cased, and the kind each may start.
KEYWORDS: dict[str, str] = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "xprv": "xprv",
}
_PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "npm": re.compile(r"(?<![A-Za-z0-9_])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "xprv": re.compile(r"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_STRIDE = LEAST_HEX // 4
_HEX, _HEX_SAMPLES = re.compile("[0-9a-f]+"), re.compile("[0-9a-f]{4,}")
_HEX_DIGITS = frozenset("0123456789abcdef")

# Alphabets of the two checksum notations.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

Span = tuple[str, int, int]


def crc_digits(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def base58check(text: str) -> bool:
    """Whether the last four of the 82 bytes that a Base58 text stands for are the double SHA-256 of the others."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 8 * 82:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


_SOUND: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: m.end(2) - m.start(2) >= LEAST_VALUE,
    "access": lambda m: m.end() - m.start() >= LEAST_ACCESS,
    "github": lambda m: crc_digits(m[1]) == m[2],
    "npm": lambda m: crc_digits(m[1]) == m[2],
    "xprv": lambda m: base58check(m[0]),
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (len(word), kind))
    auto.make_automaton()
    return auto


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, everything else and all positions as they were."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hex_runs(text: str) -> list[Span]:
    """Maximal runs of at least ``LEAST_HEX`` digits 0-9a-f."""
    out: list[Span] = []
    samples, end = text[_STRIDE - 1::_STRIDE], 0
    for hit in _HEX_SAMPLES.finditer(samples):
        for k in range(hit.start(), hit.end()):
            at = _STRIDE - 1 + _STRIDE * k
            if at < end:
                continue
            while at > end and text[at - 1] in _HEX_DIGITS:
                at -= 1
            last, end = at, _HEX.match(text, at).end()
            if end - last >= LEAST_HEX:
                out.append(("hex", last, end))
    return out


def scan(text: str) -> list[Span]:
    """Base and checked spans of a text in code points, by start, then kind as listed."""
    starts: dict[str, list[int]] = {}
    for last, (size, kind) in _automaton().iter(ascii_lower(text)):
        starts.setdefault(kind, []).append(last + 1 - size)
    out = hex_runs(text)
    for kind, places in starts.items():
        match, sound, end = _PATTERNS[kind].match, _SOUND[kind], 0
        for at in sorted(places):
            if at >= end and (m := match(text, at)):
                end = m.end()
                if sound(m):
                    out.append((kind, at, end))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def told(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def detect(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row plus n_assign, n_access, n_hex, base_sha256, spans and n_checked.

    The counts and the digest are those of the base spans; ``spans`` holds them and the checked ones, ``n_checked`` counts the
    latter. Spans of different kinds may overlap, those of one kind never do. Null and empty texts have none; repeated rows
    stay; an empty table gives an empty result. Offsets are code points, ends exclusive. Narrow: one pass, no shuffle.
    """
    def run(texts: list[str]) -> dict[str, list]:
        found = [scan(t) for t in texts]
        base = [[s for s in f if s[0] in BASE] for f in found]
        out: dict[str, list] = {f"n_{k}": pa.array([sum(1 for s in b if s[0] == k) for b in base], pa.int64()) for k in BASE}
        out["base_sha256"] = pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in base], pa.string())
        out["spans"] = pa.array([told(f) for f in found], pa.string())
        out["n_checked"] = pa.array([len(f) - len(b) for f, b in zip(found, base, strict=True)], pa.int64())
        return out

    return map_text(df, run, ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_checked bigint", keep, text)


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(load(spark, sf_dir, "documents"), ["doc_id"])
