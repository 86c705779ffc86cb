"""Split, fold and balancing queries. Draw order is md5(key|seed) on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import load, query, round_doubles
from prepspark.functions.ranks import rank_in_group, key_hash
from prepspark.operators import balance, split

_H = "md5(concat_ws('|', o_orderkey, '42'))"
_N = "(SELECT count(*) FROM orders)"


def _random_sql(share: float, test: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_H}) <= ceil({_N} * {share}::DOUBLE) THEN '{test}' ELSE 'train' END AS part FROM orders"""


@query("split_random", _random_sql(0.2, "test"))
def split_random(spark, d):
    return split.split_random(load(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "part")


@query("holdout", _random_sql(0.1, "holdout"))
def holdout(spark, d):
    return split.holdout(load(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "part")


_STRATIFIED = f"""s AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n, ceil(sum(n) * 0.2::DOUBLE)::BIGINT AS w FROM s),
q AS (SELECT c, (w * s.n) // t.n AS base, row_number() OVER (ORDER BY (w * s.n) % t.n DESC, c) AS pos FROM s, t),
k AS (SELECT c, base + (pos <= (SELECT max(w) FROM t) - (SELECT sum(base) FROM q))::INTEGER AS quota FROM q),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}) AS rn FROM orders),
p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM r JOIN k ON c = o_orderpriority)"""


@query("split_stratified", f"WITH {_STRATIFIED} SELECT o_orderkey, o_orderpriority, part FROM p")
def split_stratified(spark, d):
    return split.split_stratified(load(spark, d, "orders"), ["o_orderkey"], "o_orderpriority").select("o_orderkey", "o_orderpriority", "part")


# every line twice: over ten thousand classes of two rows and more at sf0.01
_LINES = "(SELECT l_orderkey % 12000 AS c, l_orderkey || '-' || l_linenumber || '-' || copy AS id FROM lineitem, (SELECT unnest([0, 1]) AS copy))"
_LINE_H = "md5(concat_ws('|', id, '42'))"


def _lines(spark, d):
    item = load(spark, d, "lineitem").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return item.select((F.col("l_orderkey") % 12000).alias("c"), F.concat_ws("-", "l_orderkey", "l_linenumber", "copy").alias("id"))


@query("split_stratified_many", f"""WITH o AS {_LINES}, s AS (SELECT c::VARCHAR AS c, count(*) AS n FROM o GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n, ceil(sum(n) * 0.2::DOUBLE)::BIGINT AS w FROM s),
q AS (SELECT c, (w * s.n) // t.n AS base, row_number() OVER (ORDER BY (w * s.n) % t.n DESC, c) AS pos FROM s, t),
k AS (SELECT c, base + (pos <= (SELECT max(w) FROM t) - (SELECT sum(base) FROM q))::INTEGER AS quota FROM q),
r AS (SELECT c::VARCHAR AS c, id, row_number() OVER (PARTITION BY c ORDER BY {_LINE_H}) AS rn FROM o)
SELECT id, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM r JOIN k USING (c)""")
def split_stratified_many(spark, d):
    return split.split_stratified(_lines(spark, d), ["id"], "c", max_classes=1000).select("id", "part")


@query("undersample_many", f"""WITH o AS {_LINES}, r AS (SELECT id, row_number() OVER (PARTITION BY c ORDER BY {_LINE_H}) AS rn FROM o)
SELECT id FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM o GROUP BY c))""")
def undersample_many(spark, d):
    return balance.undersample(_lines(spark, d), "c", ["id"], max_classes=1000).select("id")


@query("kfold_stratified_many", f"""WITH o AS {_LINES}, s AS (SELECT c::VARCHAR AS c, count(*) AS n FROM o GROUP BY 1),
t AS (SELECT c, n, coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 AS turn FROM s),
f AS (SELECT c, fold, n // 3 + ((fold - turn + 3) % 3 < n % 3)::INTEGER AS size FROM t, (SELECT unnest(range(0, 3)) AS fold)),
b AS (SELECT c, fold, sum(size) OVER (PARTITION BY c ORDER BY fold) AS up_to, size FROM f),
r AS (SELECT id, c::VARCHAR AS c, row_number() OVER (PARTITION BY c ORDER BY {_LINE_H}) AS rn FROM o)
SELECT id, fold::INTEGER AS fold FROM r JOIN b ON r.c = b.c AND rn <= up_to AND rn > up_to - size""")
def kfold_stratified_many(spark, d):
    return split.kfold_stratified(_lines(spark, d), ["id"], "c", 3, max_classes=1000).select("id", "fold")


@query("split_summary", f"""WITH {_STRATIFIED} SELECT part, o_orderpriority AS class, count(*)::BIGINT AS rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY part)::DOUBLE, 6) AS share FROM p GROUP BY 1, 2""")
def split_summary(spark, d):
    parts = split.split_stratified(load(spark, d, "orders"), ["o_orderkey"], "o_orderpriority")
    return round_doubles(split.split_summary(parts, "o_orderpriority"))


@query("split_auto", f"""WITH {_STRATIFIED} SELECT 'priority' AS target, part, count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys FROM p GROUP BY 2
UNION ALL SELECT 'none', part, count(*), sum(o_orderkey)::BIGINT FROM ({_random_sql(0.2, 'test')}) GROUP BY 2""")
def split_auto(spark, d):
    o = load(spark, d, "orders")
    out = None
    for name, target in (("priority", "o_orderpriority"), ("none", None)):
        one = split.split_auto(o, ["o_orderkey"], target).groupBy("part").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
        one = one.withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _timeseries_sql(table: str, order: str, key: str, splits: int = 5) -> str:
    return f"""WITH r AS (SELECT {key}, row_number() OVER (ORDER BY {order}, md5(concat_ws('|', {key}, '42'))) - 1 AS i, count(*) OVER () AS n FROM {table})
SELECT {key}, CASE WHEN i < n - {splits} * (n // {splits + 1}) THEN 0 ELSE (i - (n - {splits} * (n // {splits + 1}))) // (n // {splits + 1}) + 1 END::INTEGER AS fold FROM r"""


@query("split_timeseries", _timeseries_sql("events", "ts", "event_id"))
def split_timeseries(spark, d):
    return split.split_timeseries(load(spark, d, "events"), "ts", ["event_id"]).select("event_id", "fold")


@query("split_timeseries_ties", _timeseries_sql("orders", "date_trunc('year', o_orderdate)", "o_orderkey", 4))
def split_timeseries_ties(spark, d):
    o = load(spark, d, "orders").withColumn("year", F.date_trunc("year", F.col("o_orderdate").cast("timestamp")))
    return split.split_timeseries(o, "year", ["o_orderkey"], 4).select("o_orderkey", "fold")


@query("kfold", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H}) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (i - n % 7) // (n // 7) END::INTEGER AS fold FROM r""")
def kfold(spark, d):
    return split.kfold(load(spark, d, "orders"), ["o_orderkey"], 7).select("o_orderkey", "fold")


@query("kfold_stratified", f"""WITH s AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT c, n, coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 7 AS turn FROM s),
f AS (SELECT c, fold, n // 7 + ((fold - turn + 7) % 7 < n % 7)::INTEGER AS size FROM t, (SELECT unnest(range(0, 7)) AS fold)),
b AS (SELECT c, fold, sum(size) OVER (PARTITION BY c ORDER BY fold) AS up_to, size FROM f),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority, fold::INTEGER AS fold FROM r JOIN b ON c = o_orderpriority AND rn <= up_to AND rn > up_to - size""")
def kfold_stratified(spark, d):
    return split.kfold_stratified(load(spark, d, "orders"), ["o_orderkey"], "o_orderpriority", 7).select("o_orderkey", "o_orderpriority", "fold")


@query("kfold_group", """SELECT count(*)::BIGINT AS rows, count(DISTINCT o_custkey)::BIGINT AS groups, 1::BIGINT AS folds_per_group, 5::BIGINT AS folds, true AS balanced FROM orders""")
def kfold_group(spark, d):
    """No group in two folds; fold sizes apart by no more than the largest group."""
    f = split.kfold_group(load(spark, d, "orders"), "o_custkey")
    groups = f.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("k"), F.min("fold").alias("fold"))
    folds = groups.groupBy("fold").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.max("k").alias("k"), F.max("n").alias("big"))
    return folds.agg(
        F.sum("n").alias("rows"), F.sum("g").alias("groups"), F.max("k").alias("folds_per_group"), F.count("*").alias("folds"),
        (F.max("n") - F.min("n") <= F.max("big")).alias("balanced"),
    )


_RANK = f"""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}) - 1 AS rank FROM orders"""


@query("rank_in_group", _RANK)
def ranks(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rank_in_group(o, key_hash(["o_orderkey"]), "o_orderpriority")


@query("undersample", f"""WITH r AS ({_RANK}) SELECT o_orderkey, o_orderpriority FROM r
WHERE rank < (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))""")
def undersample(spark, d):
    return balance.undersample(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


_LABEL_H = "md5(concat_ws('|', doc_id, '42'))"


@query("oversample", f"""WITH s AS (SELECT quality::VARCHAR AS g, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT max(n) AS top FROM s),
dr AS (SELECT g, n, unnest(range(0, top - n)) AS j FROM s, t WHERE n < top),
pick AS (SELECT g, (('0x' || substr(md5(concat_ws('|', g, j, '42')), 1, 13))::BIGINT % n) AS rank FROM dr),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_LABEL_H}) - 1 AS rank FROM labels)
SELECT doc_id, quality, toxic, count(*)::BIGINT AS copies FROM (
SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM pick JOIN r ON r.rank = pick.rank AND r.quality::VARCHAR = g) GROUP BY 1, 2, 3""")
def oversample(spark, d):
    out = balance.oversample(load(spark, d, "labels"), "quality", ["doc_id"])
    return out.groupBy("doc_id", "quality", "toxic").agg(F.count("*").alias("copies"))


def _skewed(spark, d):
    """orders with a rare flag and numeric columns only."""
    o = load(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 6 == 0).cast("int").alias("flag"), "o_totalprice", F.month("o_orderdate").alias("month"))


@query("smote", """WITH t AS (SELECT (o_custkey % 6 = 0)::INTEGER AS flag, o_totalprice, month(o_orderdate) AS month FROM orders),
s AS (SELECT flag, count(*) AS n FROM t GROUP BY 1)
SELECT flag, (SELECT max(n) FROM s)::BIGINT AS n_rows, n::BIGINT AS originals, true AS within FROM s""")
def smote(spark, d):
    """Class sizes after balancing; every added row lies between the smallest and largest original of its class."""
    t = _skewed(spark, d)
    out = balance.smote(t, "flag", ["o_orderkey"])
    made = F.col("o_orderkey").isNull()
    aggs = [F.count("*").alias("n_rows"), F.count("o_orderkey").alias("originals")]
    ok = F.lit(True)
    for c in ("o_totalprice", "month"):
        ok = ok & F.coalesce((F.min(F.when(made, F.col(c))) >= F.min(F.when(~made, F.col(c)))) & (F.max(F.when(made, F.col(c))) <= F.max(F.when(~made, F.col(c)))), F.lit(True))
    return out.groupBy("flag").agg(*aggs, ok.alias("within"))




@query("smote_many", """WITH t AS (SELECT l_orderkey % 1500 AS c FROM lineitem), s AS (SELECT c, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 2)
SELECT c::BIGINT AS c, (SELECT max(n) FROM s)::BIGINT AS n_rows, n::BIGINT AS originals, true AS within FROM s""")
def smote_many(spark, d):
    """Over a thousand classes; a class's added rows stay within its own range."""
    item = load(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_orderkey") % 1500).alias("c"),
        (F.col("l_extendedprice") + (F.col("l_orderkey") % 1500) * 1_000_000).alias("x"))
    sizes = item.groupBy("c").agg(F.count("*").alias("k")).where("k > 2")
    t = item.join(sizes.select("c"), "c")
    out = balance.smote(t, "c", ["id"], k=2)
    made = F.col("id").isNull()
    inside = F.coalesce((F.min(F.when(made, F.col("x"))) >= F.min(F.when(~made, F.col("x")))) & (F.max(F.when(made, F.col("x"))) <= F.max(F.when(~made, F.col("x")))), F.lit(True))
    return out.groupBy("c").agg(F.count("*").alias("n_rows"), F.count("id").alias("originals"), inside.alias("within"))


@query("balance_auto", """WITH t AS (SELECT 'moderate' AS name, (o_custkey % 6 = 0)::INTEGER AS flag FROM orders UNION ALL SELECT 'mild', (o_custkey % 3 = 0)::INTEGER FROM orders
UNION ALL SELECT 'severe', (o_custkey % 20 = 0)::INTEGER FROM orders), c AS (SELECT name, flag, count(*) AS n FROM t GROUP BY 1, 2),
m AS (SELECT name, max(n) AS hi, min(n) AS lo FROM c GROUP BY 1)
SELECT name, flag, CASE WHEN hi / lo::DOUBLE > 10 THEN lo ELSE hi END::BIGINT AS n_rows FROM c JOIN m USING (name)""")
def balance_auto(spark, d):
    o = load(spark, d, "orders")
    out = None
    for name, m in (("mild", 3), ("moderate", 6), ("severe", 20)):
        t = o.select("o_orderkey", (F.col("o_custkey") % m == 0).cast("int").alias("flag"), "o_totalprice")
        one = balance.balance_data(t, ["o_orderkey"], "flag").groupBy("flag").agg(F.count("*").alias("n_rows")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
