"""How filters interact: what each removes in every order in which they could be applied.

A document is its mask of failed filters. In an order it is removed at the first step whose filter is in the mask. All orders that
begin with the same filters are neighbours in lexicographic order, so the orders that remove a mask at a given step by a
given filter form intervals of Lehmer ranks. The audit adds the count of every mask at the start of its intervals, takes it off at
their ends and sums over the ranks once: no order is replayed over documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepspark.llm.common import load, query, ref
from prepspark.session import materialize

FILTERS = "ABCDE"
#: Bits of the filters that a text fails by itself; the remaining one compares texts.
_OWN = {
    "A": "n_words < 50", "B": "100 * n_distinct < 65 * n_words", "C": "100 * n_upper > 5 * n_chars", "D": "marked",
}
_COUNTS = ("n", "good", "toxic")


def orders(filters: str = FILTERS) -> list[str]:
    """All orders; the position is the Lehmer rank."""
    return ["".join(p) for p in permutations(filters)]


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, from rank, to rank): the orders that remove a document of this mask at this step, ends exclusive.

    Every beginning of an order covers the ranks of its completions; it removes the masks that hold its last filter and none
    of those before.
    """
    size, out = len(filters), []
    factorial = [1]
    for k in range(1, size + 1):
        factorial.append(factorial[-1] * k)

    def grow(begun: str, left: str, rank: int) -> None:
        step = len(begun) + 1
        for k, f in enumerate(left):
            start = rank + k * factorial[size - step]
            bit, seen = 1 << filters.index(f), sum(1 << filters.index(c) for c in begun)
            out.extend((mask, step, start, start + factorial[size - step]) for mask in range(1 << size) if mask & bit and not mask & seen)
            if step < size:
                grow(begun + f, left[:k] + left[k + 1:], start)

    grow("", filters, 0)
    return out


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of every part by the filters they fail, and how many are labelled.

    Texts become digests before anything is shuffled. Equal texts fail the same of the filters A to D, so all that E needs is the
    smallest id of each digest: rows are counted per (digest, part, id), then (digest, part), then digest, with map-side sums
    and no group collected, whatever share of the rows one text has. A null part is the empty string, a null text empty; a row
    without an id never fails E, is no smaller row and has no label; repeated rows count each. A label counts once, however often it is given.
    """
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
    rows = docs.select(
        F.coalesce(ref(part).cast("string"), F.lit("")).alias("part"), ref(doc_id).alias("doc_id"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"))
    measured = rows.selectExpr(
        "part", "doc_id", "sha2(text, 256) AS digest", f"{words} AS words", "length(text) AS n_chars",
        "length(text) - length(regexp_replace(text, '[A-Z]', '')) AS n_upper", "text RLIKE '[#$%&*|]' AS marked",
    ).selectExpr("part", "doc_id", "unhex(digest) AS digest", "n_chars", "n_upper", "marked", "size(words) AS n_words", "size(array_distinct(words)) AS n_distinct")
    own = " + ".join(f"(CASE WHEN {cond} THEN {1 << FILTERS.index(f)} ELSE 0 END)" for f, cond in _OWN.items())
    slim = measured.selectExpr("part", "doc_id", "digest", f"{own} AS own")
    told = labels.where(ref("doc_id").isNotNull()).groupBy(ref("doc_id").alias("doc_id")).agg(
        F.coalesce(F.bool_or(ref("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(ref("toxic") == 1), F.lit(False)).alias("is_toxic"))
    labelled = slim.join(told, "doc_id", "left")
    per_id = labelled.groupBy("digest", "part", "own", "doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_good")).alias("good"), F.count_if(F.col("is_toxic")).alias("toxic"))
    # Rows without an id take no part in the comparison.
    free = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_free") for c in _COUNTS]
    per_part = per_id.groupBy("digest", "part", "own").agg(*[F.sum(c).alias(c) for c in _COUNTS], *free,
        F.min("doc_id").alias("first_id"), *[F.min_by(c, "doc_id").alias(f"{c}_first") for c in _COUNTS])
    per_part = materialize(per_part, "filter-masks")
    least = per_part.groupBy("digest").agg(F.min("first_id").alias("least"), F.count("*").alias("parts"))
    # A text of one part needs no look at other parts.
    spread = least.where("parts > 1").select("digest", "least")
    joined = per_part.join(spread, "digest", "left").withColumn("mine", F.expr("least IS NULL OR first_id = least"))
    fresh = {c: F.expr(f"{c}_free + CASE WHEN mine THEN coalesce({c}_first, 0) ELSE 0 END") for c in _COUNTS}
    bit = 1 << FILTERS.index("E")
    cells = F.array(
        F.struct(F.col("own").alias("mask"), *[v.alias(c) for c, v in fresh.items()]),
        F.struct((F.col("own") + bit).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in fresh.items()]))
    return joined.select("part", F.explode(cells).alias("c")).select("part", "c.*").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where("n > 0")


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic), zeros included.

    A part has at most one row per mask, so all tables here have a fixed number of rows per part. No parts give no rows.
    """
    spark = counted.sparkSession
    size, names = len(FILTERS), orders()
    # Fixed by the number of filters: it does not grow with the data.
    table = spark.createDataFrame(intervals(), "mask int, step int, lo int, hi int")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    marks = counted.join(F.broadcast(table), "mask").select("part", "step", ends.alias("e"), *_COUNTS)
    marks = marks.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in _COUNTS])
    bits = [1 << k for k in range(size)]
    totals = counted.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n")).otherwise(0)) for b in bits]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bits]).alias("alone"))
    listed = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(o).alias("filter_order")) for r, o in enumerate(names)])
    grid = totals.select("part", "total", "fails", "alone", F.explode(listed).alias("o")).select("*", "o.*").drop("o")
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    letter = F.expr(f"locate(substr(filter_order, step, 1), '{FILTERS}')")
    along, inside = W.partitionBy("part", "step").orderBy("rank"), W.partitionBy("part", "rank").orderBy("step")
    summed = grid.join(marks, ["part", "step", "rank"], "left").withColumn("filter", letter)
    summed = summed.withColumns({c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(along) for c in _COUNTS})
    return summed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(inside)).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", F.col("filter")) - F.col("n")).alias("redundant"), F.element_at("alone", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(W.partitionBy("part", "filter")).alias("shapley"))


def _sql() -> str:
    bits = " + ".join(f"(coalesce({c}, false))::INT * {1 << k}" for k, c in enumerate(
        ["len(words) < 50", "100 * len(list_distinct(words)) < 65 * len(words)",
         "100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text)", "regexp_matches(text, '[#$%&*|]')",
         "doc_id > min(doc_id) OVER (PARTITION BY text)"]))
    earlier = "(" + " + ".join(f"CASE WHEN strpos(substr(filter_order, 1, step - 1), '{f}') > 0 THEN {1 << k} ELSE 0 END" for k, f in enumerate(FILTERS)) + ")"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT part, {bits} AS mask, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(string_split('A B C D E', ' ')) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, strpos('{FILTERS}', substr(filter_order, step, 1)) - 1 AS k, {earlier} AS seen FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, k,
  coalesce(sum(n) FILTER (mask & (seen | (1 << k)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & seen = 0 AND mask & (1 << k) <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & seen <> 0 AND mask & (1 << k) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = (1 << k)), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & seen = 0 AND mask & (1 << k) <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & seen = 0 AND mask & (1 << k) <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""


@query("op12_filter_audit", _sql())
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = masks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return audit(materialize(counted, "filter-masks"))
