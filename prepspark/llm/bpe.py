"""BPE encoding and decoding by tree concatenation.

A text is cut at blanks and line breaks, across which no merge, composition or special string can reach. Pieces without
such a cut ("unsplit text") are encoded whole while they are short. A long one is normalised, split by the tokenizer's own
rule, and every word beyond ``LEAF`` characters is encoded in halves: leaves are encoded independently, then neighbours are
joined upwards. At each join a window of k tokens on both sides is encoded anew, k growing twofold, until its first token is
the left side's and its last token the right side's (or that side is used up). A token sequence is the BPE encoding of its
text exactly if every adjacent pair is the encoding of the pair's text, so agreement at both ends makes the whole exact.

Texts beyond ``LONG`` characters are spread: their pieces and leaves are rows of their own, encoded by different tasks,
and meet again only as token ids.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import blocks, load, map_text, query, ref

LEAF = 256
LONG = 400_000
PIECE = 50_000
CACHE = 150_000
TYPES = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
# Composed Latin letters, ASCII and Latin-1 signs, without the bracket that opens special strings and the dotted capital I.
SAFE = regex.compile("[!-;=-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017e]+")
SAFE_CODES = [c for c in range(0x21, 0x17F) if SAFE.fullmatch(chr(c))]
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# The printable character that stands for each byte: itself where it shows, else the next free one from U+0100.
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """One tokenizer file inside a task: piecewise encoding with a cache of recent pieces."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = {i: t for t, i in self.tok.get_vocab().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # The same merges without a word end: for stretches that do not close their word.
        self.inner = models.BPE(vocab=spec["model"]["vocab"], merges=merges)
        self.outer = self.tok.model
        self.cache: dict[str, tuple[array, str, str]] = {}
        self.words_seen: dict[str, list[int]] = {}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split.get("behavior") != "Removed" or r"\s" not in split["pattern"]["Regex"]:
            raise ValueError("the tokenizer must drop white space: only then can texts be cut at blanks")
        self.rule = regex.compile(split["pattern"]["Regex"])
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.plain_steps = steps == ["NFC", "Replace", "Lowercase"]
        self.bytes = {c: "".join(BYTES[b] for b in chr(c).encode()) for c in SAFE_CODES}

    def stretch(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.outer if last else self.inner).tokenize(text)]

    def plain(self, ids: list[int], last: bool) -> str:
        """Text of tokens; the word end is dropped if the last token closes the word."""
        s = "".join([self.vocab[i] for i in ids])
        return s[:len(s) - len(self.suffix)] if last and self.suffix else s

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of two neighbouring stretches, from theirs; ``last``: the right one closes the word."""
        if not left or not right:
            return left or right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            ends = last and len(b) == len(right)
            mid = self.stretch(self.plain(a, False) + self.plain(b, ends), ends)
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return left[:len(left) - len(a)] + mid + right[len(b):]
            k *= 2

    def concat(self, leaves: list[list[int]], last: bool = True) -> list[int]:
        """Join encoded leaves pairwise, level by level."""
        while len(leaves) > 1:
            ends = [last and i + 2 >= len(leaves) for i in range(0, len(leaves), 2)]
            leaves = [self.join(leaves[i], leaves[i + 1], e) if i + 1 < len(leaves) else leaves[i]
                      for i, e in zip(range(0, len(leaves), 2), ends, strict=True)]
        return leaves[0] if leaves else []

    def word(self, text: str, leaf: int = LEAF) -> list[int]:
        """One pre-split word."""
        cuts = halves(len(text), leaf)
        return self.concat([self.stretch(text[a:b], b == len(text)) for a, b in cuts])

    def words(self, text: str) -> list[str | int]:
        """A long piece as pre-split words, special strings as their ids."""
        out: list[str | int] = []
        for part in self.cut_special(text):
            if isinstance(part, int):
                out.append(part)
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def cut_special(self, text: str) -> list[str | int]:
        parts: list[str | int] = [text]
        if not self.tok.encode_special_tokens:
            for s in self.special:
                new: list[str | int] = []
                for p in parts:
                    bits = p.split(s) if isinstance(p, str) else [p]
                    for i, b in enumerate(bits):
                        new += [self.tok.token_to_id(s), b] if i else [b]
                parts = new
        return parts

    def piece(self, text: str) -> list[int]:
        """One piece without a blank."""
        if len(text) <= LEAF:
            if self.plain_steps and SAFE.fullmatch(text):
                return self.safe_piece(text)
            return self.tok.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for w in self.words(text):
            out += [w] if isinstance(w, int) else self.word(w)
        return out

    def safe_piece(self, text: str) -> list[int]:
        """A piece of composed Latin characters: NFC leaves them, and lower-casing and the split rule need no library call."""
        out: list[int] = []
        for w in self.rule.findall(text.lower()):
            ids = self.words_seen.get(w)
            if ids is None:
                ids = self.stretch(w.translate(self.bytes), True)
                if len(self.words_seen) >= CACHE:
                    self.words_seen.clear()
                self.words_seen[w] = ids
            out += ids
        return out

    def known(self, text: str) -> tuple[array, str, str]:
        hit = self.cache.get(text)
        if hit is None:
            ids = self.piece(text)
            hit = (array("i", ids), " ".join(map(str, ids)), " ".join([self.vocab[i] for i in ids]))
            if len(text) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[text] = hit
        return hit

    def text(self, text: str) -> list[tuple[array, str, str]]:
        """Encodings of the pieces of a text, in order."""
        get, known = self.cache.get, self.known
        return [get(p) or known(p) for p in text.replace("\n", " ").split(" ") if p]


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """Borders of the leaves of a binary tree over n characters."""
    cuts = [(0, n)]
    while max((b - a for a, b in cuts), default=0) > leaf:
        cuts = [x for a, b in cuts for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return cuts


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def outputs_of(parts: list[tuple[array, str, str]], outputs: tuple[str, ...]) -> dict[str, object]:
    """The wanted columns of one text from the encodings of its pieces."""
    parts = [p for p in parts if p[0]]
    out: dict[str, object] = {}
    if "ids" in outputs:
        ids = array("i")
        for p in parts:
            ids.extend(p[0])
        out["ids"] = ids
    if "n_tokens" in outputs:
        out["n_tokens"] = sum([len(p[0]) for p in parts])
    if "ids_sha256" in outputs:
        out["ids_sha256"] = sha(" ".join([p[1] for p in parts]))
    if "decoded" in outputs or "decoded_sha256" in outputs:
        decoded = " ".join([p[2] for p in parts])
        out |= {"decoded": decoded, "decoded_sha256": sha(decoded)}
    return {k: out[k] for k in outputs}


def encode_decode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, outputs: tuple[str, ...] = DIGESTS,
                  long: int = LONG, piece: int = PIECE) -> DataFrame:
    """Columns ``keep`` of every row plus ``outputs``: ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    Encoding adds no special tokens, decoding keeps all. A null text counts as empty (no tokens, empty decoding). Rows keep
    their number; equal rows and null keys are rows like any other. ``path`` must exist on every executor.
    """
    path = path or default_path()
    size = F.length(F.coalesce(ref(text).cast("string"), F.lit("")))
    ddl = ", ".join(f"{o} {TYPES[o]}" for o in outputs)

    def short(texts: list[str]) -> dict[str, list]:
        c = codec(path)
        rows = [outputs_of(c.text(t), outputs) for t in texts]
        return {o: pa.array([r[o] for r in rows], type=_arrow(TYPES[o])) for o in outputs}

    out = map_text(df.where(size <= long), short, ddl, keep, text)
    return out.unionByName(encode_spread(df.where(size > long), keep, text, path, outputs, piece))


def encode_spread(df: DataFrame, keep: list[str], text: str, path: str, outputs: tuple[str, ...], piece: int = PIECE) -> DataFrame:
    """Long texts: pieces and leaves become rows, encoded anywhere, joined per text as token ids; equal texts are encoded once."""
    rows = df.select(F.sha2(ref(text).cast("string"), 256).alias("__row"), F.struct(*[ref(c) for c in keep]).alias("__keep"),
                     ref(text).cast("string").alias("__text"))
    # "grp" numbers runs that are joined without a window; the leaves of one word share it.
    cut = "__row string, grp bigint, part bigint, leaf boolean, last boolean, body string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                for k, t in enumerate(texts):
                    row = batch.column(0)[start + k].as_py()
                    cells = list(_cuts(c, t, piece))
                    for a in range(0, len(cells), 200):
                        some = cells[a:a + 200]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row] * len(some), pa.string()), pa.array([x[0] for x in some], pa.int64()),
                            pa.array(range(a, a + len(some)), pa.int64()), pa.array([x[1] for x in some], pa.bool_()),
                            pa.array([x[2] for x in some], pa.bool_()), pa.array([x[3] for x in some], pa.string()),
                        ], names=["__row", "grp", "part", "leaf", "last", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            bodies = batch.column(5)
            for i in range(batch.num_rows):
                body, leaf, last = bodies[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                ids = array("i", c.stretch(body, last)) if leaf else outputs_of(c.text(body), ("ids",))["ids"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(j).slice(i, 1) for j in (0, 1, 2, 3)] + [pa.array([ids], pa.list_(pa.int32()))],
                    names=["__row", "grp", "part", "leaf", "ids"])

    def gather(key, frame):
        import pandas as pd

        c = codec(path)
        frame = frame.sort_values("part")
        ids: list[int] = []
        for _, run in frame.groupby("grp", sort=True):
            parts = [list(x) for x in run["ids"]]
            ids += c.concat(parts) if run["leaf"].iloc[0] else [i for p in parts for i in p]
        made = outputs_of([(array("i", ids), " ".join(map(str, ids)), " ".join([c.vocab[i] for i in ids]))], outputs)
        return pd.DataFrame({"__row": [key[0]], **{o: [list(v) if o == "ids" else v] for o, v in made.items()}})

    pieces = rows.select("__row", "__text").dropDuplicates(["__row"]).mapInArrow(split, cut).hint("rebalance")
    ids = pieces.mapInArrow(encode, "__row string, grp bigint, part bigint, leaf boolean, ids array<int>")
    ddl = ", ".join(["__row string", *[f"{o} {TYPES[o]}" for o in outputs]])
    made = ids.groupBy("__row").applyInPandas(gather, ddl)
    return rows.drop("__text").join(made, "__row").select(*[F.col("__keep").getField(c).alias(c) for c in keep], *outputs)




def _cuts(c: Codec, text: str, piece: int) -> Iterator[tuple[int, bool, bool, str]]:
    """(group, leaf, closes its word, body): runs of pieces, and leaves of words too long to stand with them."""
    group, run, size = 0, [], 0
    for p in text.replace("\n", " ").split(" "):
        if len(p) > piece:
            if run:
                yield group, False, True, " ".join(run)
                group, run, size = group + 1, [], 0
            for w in c.words(p):
                if isinstance(w, int):
                    yield group, False, True, c.vocab[w]
                else:
                    for a, b in halves(len(w), piece):
                        yield group, True, b == len(w), w[a:b]
                group += 1
        elif p:
            run.append(p)
            size += len(p)
            if size >= piece:
                yield group, False, True, " ".join(run)
                group, run, size = group + 1, [], 0
    if run or group == 0:
        yield group, False, True, " ".join(run)


def _arrow(ddl: str) -> pa.DataType:
    return {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}[ddl]


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """Columns ``keep`` plus ``decoded``, as the library decodes the ids with special tokens kept; null ids give an empty text."""
    path = path or default_path()
    src = df.select(*[ref(c) for c in keep], ref(ids).cast("array<int>").alias("__ids"))
    out = src.select(*[ref(c) for c in keep]).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path).tok
        for batch in batches:
            rows = [tok.decode(x or [], skip_special_tokens=False) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.string())], names=[*keep, "decoded"])

    return src.mapInArrow(run, out)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), ["doc_id"])
