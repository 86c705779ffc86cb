"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit per failed rule. A policy is a
versioned mask over the bits; applying another version, or asking what a single rule costs, reads only the ledger.
All expressions are built-in, so the ledger is one narrow pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import load, query, ref

WINDOW = 8

# Rule name and the condition, over the measurements, under which a document fails it. The position is the bit.
RULES: list[tuple[str, str]] = [
    ("short", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("long_words", "word_chars > 20 * n_words"),
    ("tiny_words", "2 * word_chars < 3 * n_words"),
    ("lines", "10 * n_dup_lines > 5 * n_lines"),
]
BASE = ("short", "repeats")
# Policy versions: the rules a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": ("short", "repeats", "symbols", "long_words", "tiny_words"),
    "v2": ("short", "repeats", "symbols", "long_words", "tiny_words", "lines"),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    """Bits of the named rules; the base rules always count."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in {*rules, *BASE})


def measured(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every document.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (such lines equal to an
    earlier one), n_repeat_words (words in windows of eight that occur twice or more in the text). A null text counts as
    empty: all measurements are 0. A null ``doc_id`` is carried through.
    """
    src = df.select(ref(doc_id).alias("doc_id"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
    lines = "filter(split(text, '\\\\n', -1), l -> length(trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM l)) > 0)"
    parts = src.selectExpr(
        "doc_id", "length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) AS n_symbols",
        f"{words} AS words", f"{lines} AS lines",
    )
    counted = parts.selectExpr(
        "doc_id", "words", "n_symbols", "size(words) AS n_words", "length(array_join(words, '')) AS word_chars",
        "size(lines) AS n_lines", "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
        f"""CASE WHEN size(words) > {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}),
              i -> xxhash64(slice(words, i, {WINDOW}))) END AS hashes""",
    )
    # Starts of windows that occur again; only texts with a repeated window reach the sort.
    starts = counted.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        """CASE WHEN size(array_distinct(hashes)) < size(hashes)
             THEN array_sort(transform(hashes, (h, i) -> struct(h, i))) END AS ordered""",
    ).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        """array_sort(transform(filter(ordered, (x, k) -> (k > 0 AND ordered[k - 1].h = x.h)
             OR (k < size(ordered) - 1 AND ordered[k + 1].h = x.h)), x -> x.i)) AS starts""",
    )
    covered = f"""coalesce(aggregate(transform(starts, (s, k) ->
        CASE WHEN k < size(starts) - 1 THEN least({WINDOW}, starts[k + 1] - s) ELSE {WINDOW} END), 0, (a, x) -> a + x), 0)"""
    return starts.selectExpr(
        "doc_id", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")],
        f"CAST({covered} AS BIGINT) AS n_repeat_words",
    )


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements plus ``fail_bits``: bit k is set where rule k fails. One row per input row, ties and repeats included."""
    bits = " | ".join(f"(CASE WHEN {cond} THEN {1 << k}L ELSE 0L END)" for k, (_, cond) in enumerate(RULES))
    return measured(df, doc_id, text).withColumn("fail_bits", F.expr(bits))


def passes(version: str = CURRENT) -> Column:
    """True where a ledger row meets the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Ledger with ``base_failed``, ``kept`` and the policy version."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0
    return book.withColumns({"base_failed": base, "kept": passes(version), "policy": F.lit(version)})


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if the rule were dropped.

    One aggregation over at most 2 ** rules distinct bit patterns; an empty ledger gives zero counts.
    """
    rules = [n for n, _ in RULES]
    used = [r for r in rules if mask(POLICIES[version]) >> rules.index(r) & 1]
    whole = mask(POLICIES[version])
    failed = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("bigint"))
    counts = book.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    one = "CAST(coalesce(sum(CASE WHEN {} THEN n END), 0) AS BIGINT)"
    cells = ", ".join(
        f"named_struct('rule', '{r}', 'failing', {one.format(f'bits & {1 << rules.index(r)} <> 0')}, "
        f"'failing_alone', {one.format(f'bits = {1 << rules.index(r)}')}, "
        f"'kept_without', {one.format(f'bits & {whole & ~(1 << rules.index(r))} = 0')})"
        for r in used
    )
    return counts.agg(F.expr(f"array({cells})").alias("cells")).selectExpr("inline(cells)")


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, row_number() OVER () AS rid FROM w),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM m)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
x AS (SELECT m.* EXCLUDE (words, rid), coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 20)::BIGINT + (100 * n_repeat_words > 30 * n_words)::BIGINT * 2 + (100 * n_symbols > 5 * word_chars)::BIGINT * 4
  + (word_chars > 20 * n_words)::BIGINT * 8 + (2 * word_chars < 3 * n_words)::BIGINT * 16 + (10 * n_dup_lines > 5 * n_lines)::BIGINT * 32
  AS fail_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, fail_bits = 0 AS kept, 'v2' AS policy FROM b
"""


@query("op3_quality_rules", _SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(load(spark, sf_dir, "documents")))
