"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to four letters (words are padded by a blank, everything but letters is a blank).
Document frequencies come from all training texts. The regression is trained by follow-the-regularised-leader with an
elastic net on a bounded sample, at most ``PER_LANG`` texts a language, in one streaming task; a fifth of the sample is
set aside to find the temperature. Scoring is a narrow pass with the weights broadcast (languages x ``BUCKETS`` numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import blocks, edit_text, load, map_text, query, ref

BUCKETS = 1 << 16
ORDERS = 4
PER_LANG = 1500
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the whole text, ascending, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint32)
    grams, h = [], np.zeros(len(c) + 1, dtype=np.uint32)
    for n in range(ORDERS):
        h = (h[:len(c) - n] + c[n:]) * np.uint32(0x9E3779B1)
        grams.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n) >> np.uint32(16))
        if len(c) - n <= 1:
            break
    every = np.concatenate(grams)
    if len(every) < 2000:
        return np.unique(every, return_counts=True)
    n = np.bincount(every, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF values."""
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size else x


class Regression:
    """Multinomial logistic regression with per-coordinate follow-the-regularised-leader steps."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = softmax((x @ w)[None])[0]
        slope[label] -= 1
        g = x[:, None] * slope
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
        self.n[at] = new


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits with the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """Number of texts that hold each bucket; a task adds up its own, BUCKETS rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, some in blocks(batch.column(0)):
                for t in some:
                    total[counts(t)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[bucket] = n
    return out


def fit(df: DataFrame, per_lang: int = PER_LANG, epochs: int = EPOCHS) -> dict | None:
    """Model from rows (text, lang) with non-null cells; None without any. The sample does not depend on partitioning.

    Keys: langs (sorted), weights (BUCKETS x langs, float32), bias (log share of each language against the sample's), temperature, idf.
    """
    rows = df.where("text IS NOT NULL AND lang IS NOT NULL")
    told = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("text")).alias("texts")).collect()
    sizes, texts = {r.lang: r.n for r in told}, {r.lang: r.texts for r in told}
    if not sizes:
        return None
    langs = sorted(sizes)
    total = sum(sizes.values())
    idf = np.log((1 + total) / (1 + _document_frequencies(rows.select("text")))) + 1
    shared = df.sparkSession.sparkContext.broadcast(idf)
    # A hash threshold by the number of different texts takes somewhat more than wanted, copies count once, ranks within what is left
    # cut it to the bound.
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.5 * per_lang / texts[k]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000).cast("bigint")) / 1_000_000
    some = rows.where(draw < share[F.col("lang")]).dropDuplicates(["lang", "text"]).withColumn("order", F.xxhash64(F.lit(1), "text"))
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY order, text)")
    some = some.withColumn("rank", rank).where(F.col("rank") <= per_lang)
    number = {k: i for i, k in enumerate(langs)}
    names = F.create_map(*[F.lit(x) for k in langs for x in (k, number[k])])
    sample = some.select("text", names[F.col("lang")].cast("int").alias("label"), "rank").repartition(1).sortWithinPartitions(F.xxhash64("rank", "label"), "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        model = Regression(len(langs))
        seen, aside = [], []
        for batch in batches:
            labels, ranks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for start, texts in blocks(batch.column(0)):
                for k, t in enumerate(texts):
                    at, x = features(t, idf)
                    row = (at.astype(np.uint16), x.astype(np.float32), labels[start + k])
                    (aside if ranks[start + k] % 5 == 0 else seen).append(row)
        for _ in range(epochs):
            for at, x, label in seen:
                model.learn(at, x.astype(float), label)
        w = model.weights(slice(None))
        logits = np.array([x @ w[at] for at, x, _ in aside]).reshape(-1, len(langs))
        t = temperature(logits, np.array([label for *_, label in aside], dtype=int))
        n = np.bincount([label for *_, label in seen], minlength=len(langs))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([t]), pa.array([n.tolist()], pa.list_(pa.int64()))],
                                         names=["weights", "temperature", "n"])

    made = sample.mapInArrow(train, "weights binary, temperature double, n array<bigint>").first()
    used = np.maximum(np.array(made.n, dtype=float), 1)
    whole = np.array([sizes[k] for k in langs], dtype=float)
    return {"langs": langs, "weights": np.frombuffer(made.weights, "<f4").reshape(BUCKETS, -1), "temperature": made.temperature, "idf": idf,
            "bias": np.log(whole / whole.sum()) - np.log(used / used.sum())}


def predict(df: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row plus lang_pred and score (0 to 1).

    ``und`` with score 0 for a null text, one without a letter, or without a model. Equal texts get equal answers; ties go to the first language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        names, scores = zip(*[answer(shared.value, t) for t in texts], strict=True) if texts else ((), ())
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_text(df, run, "lang_pred string, score double", keep, text)


def answer(m: dict | None, text: str) -> tuple[str, float]:
    """Language and calibrated score of one text."""
    if m is None or not has_letter(text):
        return UNKNOWN, 0.0
    at, x = features(text, m["idf"])
    p = softmax((x @ m["weights"][at]) / m["temperature"] + m["bias"])
    k = int(p.argmax())
    return m["langs"][k], min(1.0, float(p[k]))


def accepted(df: DataFrame, model: dict | None, text: str = "text", least: float = 0.4) -> DataFrame:
    """Rows whose language is known with a score of ``least`` or more; all columns as they are. Null and letterless texts go."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        said = [answer(shared.value, t) for t in texts]
        return batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in said], pa.bool_()))

    return edit_text(df, run, text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of five. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    rows = df.select(ref(doc_id).alias("doc_id"), held_out(ref(doc_id)).alias("held_out"), ref(text).cast("string").alias("text"), ref(lang).cast("string").alias("lang"))
    model = fit(rows.where("NOT held_out").select("text", "lang"))
    return predict(rows, model, ["doc_id", "held_out"])


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
