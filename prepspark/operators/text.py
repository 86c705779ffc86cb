"""Text features: counts, vocabulary sequences, tf-idf and lexicon scores."""

from __future__ import annotations

import json
import math
import re
import zlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepspark.functions.columns import col, one_row, real
from prepspark.functions.lookups import BROADCAST_BYTES, BROADCAST_ROWS, HOT_BYTES
from prepspark.operators.profile import collect_profile, is_text

# Whitespace as Python's str.split sees it, and the characters a
# Keras-style tokenizer replaces by a space.
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
# Words that turn the next lexicon word around, and words that strengthen or weaken it, by their factor.
NEGATIONS = ("not", "no", "never", "nor", "neither", "without")
STRENGTHS = {
    "very": 1.3, "really": 1.3, "so": 1.2, "too": 1.2, "extremely": 1.5, "absolutely": 1.5, "highly": 1.4, "quite": 1.1, "rather": 0.9, "fairly": 0.9,
    "somewhat": 0.7, "slightly": 0.5, "barely": 0.4, "hardly": 0.4,
}
#: what a negated score is multiplied by
TURNED = -0.5
#: vocabulary indices are kept below this
VOCAB_SIZE = 1_000
#: lexicon words that become one literal table
MAP_WORDS = 20_000
#: lexicon words, in times of the broadcast bound, that are broadcast as a table of short rows
JOINED_WORDS = 5
#: steps in which a doubling of a word's frequency counts
LEVELS = 4
_SLOTS = 64


def text_of(name: str) -> Column:
    """Text with null read as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def word_count(c: Column) -> Column:
    return _count(c, f"[^{SPACE_CLASS}]+")


def basic_columns(name: str) -> dict[str, Column]:
    c = text_of(name)
    return {
        f"{name}_length": F.length(c).cast("long"), f"{name}_word_count": word_count(c),
        f"{name}_has_uppercase": c.rlike(r"\p{Lu}"), f"{name}_has_digits": c.rlike(r"\p{Nd}"),
    }


def text_basic(df: DataFrame, cols: list[str]) -> DataFrame:
    """Length, word count, any upper case, any digit."""
    added = {n: e for c in cols for n, e in basic_columns(c).items()}
    return df.withColumns(added) if added else df


def text_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Characters, words, mean word length, digits, upper, lower and special characters."""
    added: dict[str, Column] = {}
    for name in cols:
        c = text_of(name)
        chars, words = F.length(c).cast("long"), word_count(c)
        added.update({
            f"{name}_char_count": chars, f"{name}_word_count": words,
            f"{name}_avg_word_length": chars / F.greatest(words, F.lit(1)),
            f"{name}_digit_count": _count(c, r"\p{Nd}"), f"{name}_uppercase_count": _count(c, r"\p{Lu}"),
            f"{name}_lowercase_count": _count(c, r"\p{Ll}"),
            f"{name}_special_count": _count(c, rf"[^\p{{L}}\p{{N}}{SPACE_CLASS}]"),
        })
    return df.withColumns(added) if added else df


def keras_tokens(name: str) -> Column:
    """Lower-cased tokens with punctuation removed, split at blanks."""
    clean = F.translate(F.lower(text_of(name)), KERAS_FILTERS, " " * len(KERAS_FILTERS))
    return F.filter(F.split(clean, " +"), lambda w: w != "")


def text_vocab(df: DataFrame, name: str, size: int = VOCAB_SIZE) -> DataFrame:
    """(word, n, idx): the most frequent words, index 1 upwards, ties by word.

    Counting is a partial aggregation before the shuffle, so frequent words move
    as one row per task; the top rows are kept by a bounded heap.
    """
    counts = df.select(F.explode(keras_tokens(name)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size - 1).collect()
    rows = [(r["word"], r["n"], i + 1) for i, r in enumerate(top)]
    return df.sparkSession.createDataFrame(rows, "word string, n long, idx int")


def _slot_maps(vocab: dict[str, int]) -> Column:
    """Vocabulary as an array of small maps chosen by checksum: a map lookup scans its keys in turn."""
    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for w, i in vocab.items():
        slots[zlib.crc32(w.encode("utf-8")) % _SLOTS][w] = i
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def sequence_columns(name: str, vocab: dict[str, int], max_length: int | None = None) -> dict[str, Column]:
    maps = _slot_maps(vocab)
    index = lambda w: F.element_at(F.element_at(maps, F.pmod(F.crc32(w), F.lit(_SLOTS)).cast("int") + 1), w)
    known = F.filter(F.transform(keras_tokens(name), index), lambda i: i.isNotNull())
    last, length = known, F.size(known)
    if max_length is not None:
        last = F.slice(known, F.greatest(F.size(known) - (max_length - 1), F.lit(1)), F.lit(max_length))
        length = F.least(length, F.lit(max_length))
    return {
        f"{name}_sequence_length": length,
        f"{name}_sequence_sum": F.aggregate(last, F.lit(0).cast("long"), lambda a, i: a + i),
    }


def text_sequence(df: DataFrame, name: str, size: int = VOCAB_SIZE, max_length: int | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Number and sum of the in-vocabulary token indices of each text; of the last ``max_length`` if asked for."""
    vocab = {r["word"]: r["idx"] for r in text_vocab(fit_on or df, name, size).collect()}
    if not vocab:
        return df.withColumns({f"{name}_sequence_length": F.lit(0), f"{name}_sequence_sum": F.lit(0).cast("long")})
    return df.withColumns(sequence_columns(name, vocab, max_length))


def word_tokens(name: str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(name)), F.lit(WORD_TOKEN), F.lit(0))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == F.lit(term)))


def text_tfidf(df: DataFrame, name: str, max_features: int = 10, max_mean_length: float | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """``{name}_tfidf_i`` for the most frequent terms, alphabetical, rows scaled to unit length.

    Two small aggregations find the terms and their document counts; the
    features are expressions per row. With ``max_mean_length`` longer texts (by
    their mean) are left alone.
    """
    source = fit_on or df
    size = one_row(source, {"n": F.count("*"), "len": F.avg(F.length(text_of(name)))})
    if not size["n"] or (max_mean_length is not None and size["len"] >= max_mean_length):
        return df
    counts = source.select(F.explode(word_tokens(name)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    terms = sorted(r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(max_features).collect())
    if not terms:
        return df
    tokens = F.col("__tokens")
    present = source.select(word_tokens(name).alias("__tokens"))
    dfs = one_row(present, {t: F.count_if(F.array_contains(tokens, F.lit(t))) for t in terms})
    idf = {t: F.log(F.lit((1.0 + size["n"]) / (1.0 + dfs[t]))) + 1.0 for t in terms}
    tf = {t: _occurrences(tokens, t) for t in terms}
    weighted = df.withColumn("__tokens", word_tokens(name)).withColumns({f"__w{i}": tf[t] * idf[t] for i, t in enumerate(terms)})
    square = None
    for i in range(len(terms)):
        w = F.col(f"__w{i}")
        square = w * w if square is None else square + w * w
    scaled = weighted.withColumn("__norm", F.sqrt(square))
    added = {f"{name}_tfidf_{i}": F.when(F.col("__norm") > 0, F.col(f"__w{i}") / F.col("__norm")).otherwise(F.lit(0.0)) for i in range(len(terms))}
    return scaled.withColumns(added).drop("__tokens", "__norm", *[f"__w{i}" for i in range(len(terms))])


def _said(name: str, acting: list[str]) -> Column:
    """Array of the words of a text, each after the run of acting words right before it, by single blanks.

    A run is taken as it stands: the pattern need not go back into one, as a word always follows. So it takes no stack, whatever its length.
    """
    if not acting:
        return word_tokens(name)
    said = F.regexp_replace(F.lower(text_of(name)), r"n['\u2019]t\b", " not")
    joined = F.array_join(F.regexp_extract_all(said, F.lit(WORD_TOKEN), F.lit(0)), " ")
    return F.regexp_extract_all(joined, F.lit("(?:(?:" + "|".join(re.escape(w) for w in acting) + ") )*+[^ ]+"), F.lit(0))


def _last(said: Column) -> Column:
    return F.substring_index(said, " ", -1)


def _strength(said: Column, negations: tuple[str, ...], strengths: dict[str, float]) -> tuple[Column, Column]:
    """Strength of the run before a word, and whether it turns the word around."""
    quote = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = "map(" + ", ".join(f"{quote(w)}, {real(f)}" for w, f in strengths.items()) + ")" if strengths else "CAST(map() AS map<string, double>)"
    alone, run = ~F.contains(said, F.lit(" ")), F.split(said, " ")  # the word itself, last in the run, is no acting word
    strength = F.when(alone, F.lit(1.0)).otherwise(
        F.aggregate(run, F.lit(1.0), lambda a, x: a * F.coalesce(F.element_at(F.expr(table), x), F.lit(1.0))))
    return strength, ~alone & F.exists(run, lambda x: x.isin(*negations)) if negations else F.lit(False)


def _over(number: float, strength: Column) -> Column:
    """A number over a strength; that of a long run may be as small as zero, which divides to infinity."""
    return F.when(strength == 0.0, F.lit(math.copysign(math.inf, number))).otherwise(F.lit(number) / strength)


def _factors(strength: Column, turns: Column) -> tuple[Column, Column]:
    return F.when(turns, _over(TURNED, strength)).otherwise(strength), F.when(turns, _over(1.0, strength)).otherwise(strength)


def _acting(negations: tuple[str, ...], strengths: dict[str, float]) -> list[str]:
    return sorted({*negations, *strengths}, key=lambda w: (-len(w), w))


def carried_words(name: str, negations: tuple[str, ...], strengths: dict[str, float]) -> Column:
    """Array of (w, fp, fs): the words of a text with the factors that the words right before them put on their scores.

    A run of negations and strength words acts on the word after it, whatever that is, and on no other. Its strength is the
    product of its factors. Without a negation fp = fs = strength; with one, however many, fp = -0.5 / strength and
    fs = 1 / strength: "not very good" is a weaker "not good". Negations and strength words have no score themselves; "n't" counts as "not".
    """
    acting = _acting(negations, strengths)
    if not acting:
        return F.transform(word_tokens(name), lambda w: F.struct(w.alias("w"), F.lit(1.0).alias("fp"), F.lit(1.0).alias("fs")))
    kept = F.filter(_said(name, acting), lambda x: ~_last(x).isin(*acting))

    def read(x: Column) -> Column:
        strength, turns = _strength(x, negations, strengths)
        return F.struct(_last(x).alias("w"), strength.alias("f"), turns.alias("t"))

    def factors(x: Column) -> Column:
        fp, fs = _factors(x["f"], x["t"])
        return F.struct(x["w"].alias("w"), fp.alias("fp"), fs.alias("fs"))

    return F.transform(F.transform(kept, read), factors)


def carried_rows(df: DataFrame, name: str, key: str, negations: tuple[str, ...], strengths: dict[str, float]) -> DataFrame:
    """``carried_words`` as rows (__k, word, fp, fs), which compiled code makes: an array of structs is built value by value."""
    acting = _acting(negations, strengths)
    said = df.select(col(key).alias("__k"), F.explode(_said(name, acting)).alias("x"))
    if not acting:
        return said.select("__k", F.col("x").alias("word"), F.lit(1.0).alias("fp"), F.lit(1.0).alias("fs"))
    strength, turns = _strength(F.col("x"), negations, strengths)
    read = said.select("__k", "x", _last(F.col("x")).alias("word")).where(~F.col("word").isin(*acting)).select("__k", "word", strength.alias("f"), turns.alias("t"))
    fp, fs = _factors(F.col("f"), F.col("t"))
    return read.select("__k", "word", fp.alias("fp"), fs.alias("fs"))


def _scaled(score: Column, factor: Column, low: float) -> Column:
    """A lexicon score under its factor; only scores that a factor changes are held within their range."""
    return F.when(factor == 1.0, score).otherwise(F.greatest(F.lit(low), F.least(F.lit(1.0), score * factor)))


def text_sentiment(
    df: DataFrame, name: str, key: str, lexicon: DataFrame, broadcast_rows: int = BROADCAST_ROWS, negations: tuple[str, ...] = NEGATIONS,
    strengths: dict[str, float] = STRENGTHS, weight: str | None = None,
) -> DataFrame:
    """``{name}_sentiment`` and ``_subjectivity``: mean lexicon scores of a text's words, 0 without any.

    Negations and strength words act on the word after them (``carried_words``); without either, all words count as they are.

    ``lexicon(word, polarity, subjectivity)`` is the user's; ``key`` is unique. A small lexicon (its rows and bytes are
    counted) becomes a map that each row looks its words up in: no shuffle at all. A larger one, up to ``JOINED_WORDS`` times
    ``broadcast_rows``, is broadcast to the words where they lie, and one sum per task and row is shuffled. Beyond, that holds for its
    most frequent words, and only the others are counted per row and shuffled to their scores (``_shared_scores``). ``weight`` names a
    column of the lexicon that tells how frequent a word is, which decides where a word is looked up and nothing else; without it
    the words of ``df`` are counted. The texts stay where they are if the scores are few enough to be broadcast.
    """
    lex = lexicon.select("word", F.col("polarity").cast("double").alias("p"), F.col("subjectivity").cast("double").alias("s"), *([F.col(weight).cast("double").alias("n")] if weight else []))
    lex = lex.persist(StorageLevel.MEMORY_AND_DISK)
    size = lex.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    names = (f"{name}_sentiment", f"{name}_subjectivity")
    if size["n"] <= min(broadcast_rows, MAP_WORDS) and size["b"] <= BROADCAST_BYTES:
        rows = lex.where("word IS NOT NULL").groupBy("word").agg(F.collect_list("p").alias("p"), F.collect_list("s").alias("s")).collect()
        lex.unpersist()
        pairs = {r["word"]: (r["p"], r["s"]) for r in rows}
        return _mapped_sentiment(df, name, pairs, names, carried_words(name, negations, strengths)) if pairs else df.withColumns({n: F.lit(0.0) for n in names})
    words = carried_rows(df, name, key, negations, strengths)
    if size["n"] <= JOINED_WORDS * broadcast_rows and size["b"] <= BROADCAST_BYTES:
        sums = words.join(F.broadcast(lex), "word").select("__k", *_scores(), F.lit(1).alias("c"))
    else:
        sums = _shared_scores(words, lex, broadcast_rows)
    scores = sums.groupBy("__k").agg((F.sum("p") / F.sum("c")).alias("__p"), (F.sum("s") / F.sum("c")).alias("__s"))
    out = df.join(scores, col(key) == F.col("__k"), "left")
    return out.withColumns(dict(zip(names, (F.coalesce("__p", F.lit(0.0)), F.coalesce("__s", F.lit(0.0)))))).drop("__k", "__p", "__s")


def _scores() -> tuple[Column, Column]:
    return _scaled(F.col("p"), F.col("fp"), -1.0).alias("p"), _scaled(F.col("s"), F.col("fs"), 0.0).alias("s")


def _shared_scores(words: DataFrame, lex: DataFrame, broadcast_rows: int) -> DataFrame:
    """Sums (__k, p, s, c) of the scores of ``words`` and their numbers, several rows for a key, by a lexicon too large to be broadcast.

    Its most frequent words, as many as may be broadcast, meet the words where they lie; of those a task sends one sum per key. The other
    words are counted per key and factor, sent to their scores, and stay if they have none. Any word is looked up in one of both.
    """
    if "n" not in lex.columns:
        lex = lex.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    n = F.max("n").over(Window.partitionBy("word"))  # a word has one place, however often it is in the lexicon
    level = F.floor(F.log2(F.greatest(F.coalesce(n, F.lit(1.0)), F.lit(1.0))) * LEVELS).cast("int")
    level = F.when(F.octet_length("word") <= HOT_BYTES, level).otherwise(F.lit(-1))
    lex = lex.where("word IS NOT NULL").select("word", "p", "s", level.alias("level")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = lex.where("level >= 0").groupBy("level").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("b")).collect()
    least, rows, size = 2**31 - 1, 0, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        rows, size = rows + r["n"], size + r["b"]
        if rows > broadcast_rows or size > BROADCAST_BYTES:
            break
        least = r["level"]
    hot = lex.where(F.col("level") >= least).select("word", "p", "s", F.lit(True).alias("hot"))
    met = words.join(F.broadcast(hot), "word", "left")
    left = lambda c: F.when(F.col("hot").isNull(), F.col(c)).alias(c)
    met = met.select("__k", left("word"), left("fp"), left("fs"), *_scores())
    sums = met.groupBy("__k", "word", "fp", "fs").agg(F.sum("p").alias("hp"), F.sum("s").alias("hs"), F.count("*").alias("c"))
    # sums have no word: they match nothing below, and the number spreads them
    sums = sums.withColumn("at", F.when(F.col("word").isNull(), F.pmod(F.xxhash64("__k"), F.lit(4096))).otherwise(F.lit(0)))
    cold = lex.where(F.col("level") < least).select("word", "p", "s", F.lit(0).cast("long").alias("at"), F.lit(True).alias("found"))
    p, s = _scores()
    of = lambda sums, score: F.when(F.col("word").isNull(), F.col(sums)).when(F.col("found"), score * F.col("c"))
    return sums.join(cold, ["word", "at"], "left").select(
        "__k", of("hp", p).alias("p"), of("hs", s).alias("s"), F.when(F.col("word").isNull() | F.col("found"), F.col("c")).alias("c"))


def _mapped_sentiment(df: DataFrame, name: str, scores: dict[str, tuple[list, list]], names: tuple[str, str], words: Column) -> DataFrame:
    """Mean scores by looking the words of a row up in a literal table, split in slots so that a lookup scans a few entries."""
    slots: list[list[str]] = [[] for _ in range(_SLOTS)]
    for w in sorted(scores):
        slots[zlib.crc32(w.encode()) % _SLOTS].append(w)
    quote = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    nums = lambda xs: "array(" + ", ".join(real(x) for x in xs if x is not None) + ")" if any(x is not None for x in xs) else "CAST(array() AS array<double>)"
    maps = [
        "map(" + ", ".join(f"{quote(w)}, named_struct('p', {nums(scores[w][0])}, 's', {nums(scores[w][1])})" for w in slot) + ")" if slot
        else "CAST(map() AS map<string, struct<p: array<double>, s: array<double>>>)" for slot in slots
    ]
    table = F.expr(f"array({', '.join(maps)})")
    entry = lambda w: F.element_at(F.element_at(table, F.pmod(F.crc32(w), F.lit(_SLOTS)).cast("int") + 1), w)
    found = F.filter(F.transform(words, lambda x: F.struct(entry(x["w"]).alias("r"), x["fp"].alias("fp"), x["fs"].alias("fs"))), lambda x: x["r"].isNotNull())
    found = F.transform(found, lambda x: F.struct(
        F.transform(x["r"]["p"], lambda v: _scaled(v, x["fp"], -1.0)).alias("p"), F.transform(x["r"]["s"], lambda v: _scaled(v, x["fs"], 0.0)).alias("s")))
    out = df.withColumn("__hits", found)
    mean = lambda f: F.coalesce(F.try_divide(
        F.aggregate(F.flatten(F.transform("__hits", lambda r: r[f])), F.lit(0.0), lambda a, x: a + x),
        F.size(F.flatten(F.transform("__hits", lambda r: r[f])))), F.lit(0.0))
    return out.withColumns({names[0]: mean("p"), names[1]: mean("s")}).drop("__hits")


def process_text_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Basic features and vocabulary sequence of each text column (rule b where none are given)."""
    if cols is None:
        cols = [p.name for p in collect_profile(df) if is_text(p, "b")]
    out = text_basic(df, cols)
    for c in cols:
        out = text_sequence(out, c, fit_on=df)
    return out


def create_text_features(df: DataFrame, cols: list[str], max_features: int = 10) -> DataFrame:
    """Counts and tf-idf of the text columns."""
    out = df
    for c in cols:
        out = text_tfidf(text_counts(out, [c]), c, max_features, fit_on=df)
    return out
