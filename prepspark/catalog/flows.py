"""Whole preparation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import ITEM_KEYS, gaps, load, query, round_doubles, spread
from prepspark.operators import clean, encode, profile, scale
from prepspark.plans import prepare as flows

_KEPT = ["l_quantity", "l_extendedprice", "l_discount"]
_SUMS = ", ".join(f"round(sum({c}), 4) + 0.0 AS {c}" for c in _KEPT)


@query("prepared_summary", f"""WITH g AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, l_extendedprice AS p, l_discount AS x,
  CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS f, l_linestatus AS s FROM lineitem),
h AS (SELECT coalesce(q, (SELECT median(q) FROM g)) AS q, p, x,
  coalesce(f, (SELECT f FROM g WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)) AS f, s FROM g),
z AS (SELECT (q - (SELECT avg(q) FROM h)) / (SELECT stddev_pop(q) FROM h) AS l_quantity, (p - (SELECT avg(p) FROM h)) / (SELECT stddev_pop(p) FROM h) AS l_extendedprice,
  (x - (SELECT avg(x) FROM h)) / (SELECT stddev_pop(x) FROM h) AS l_discount, (f = 'N')::INTEGER AS l_returnflag_N, (f = 'R')::INTEGER AS l_returnflag_R,
  (s = (SELECT max(s) FROM h))::INTEGER AS l_linestatus FROM h)
SELECT l_returnflag_N, l_returnflag_R, l_linestatus, count(*)::BIGINT AS n_rows, {_SUMS} FROM z GROUP BY 1, 2, 3""")
def prepared_summary(spark, d):
    """Profile, drop sparse columns, impute, encode and scale; then sums per dummy combination."""
    g = profile.validate_nonempty(gaps(spark, d))
    full = clean.impute_auto(g)
    ready = scale.scale_standard(encode.encode_categorical(full, exclude=ITEM_KEYS), _KEPT)
    out = ready.groupBy("l_returnflag_N", "l_returnflag_R", "l_linestatus").agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in _KEPT])
    return round_doubles(out, 4)


@query("transform_flow", """WITH t AS (SELECT quality FROM labels JOIN documents USING (doc_id))
SELECT quality, (SELECT CASE WHEN max(n) / min(n)::DOUBLE > 10 THEN min(n) ELSE max(n) END FROM (SELECT count(*) AS n FROM t GROUP BY quality))::BIGINT AS n_rows, true AS numeric_only FROM t GROUP BY 1""")
def transform_flow(spark, d):
    """Labelled documents, imbalanced: class sizes after the run and whether only numbers are left."""
    t = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    out = flows.transform_table(spread(t), "quality", ["doc_id"])
    numeric = all(k not in ("string", "array") for _, k in out.dtypes)
    return out.groupBy("quality").agg(F.count("*").alias("n_rows"), F.max(F.lit(numeric)).alias("numeric_only"))


@query("feature_flow", "SELECT o_orderstatus, count(*)::BIGINT AS n_rows, sum(o_orderkey)::BIGINT AS keys, 20::BIGINT AS n_features FROM orders GROUP BY 1")
def feature_flow(spark, d):
    out = flows.feature_table(load(spark, d, "orders"), "o_orderstatus", keys=["o_orderkey"])
    numeric = [c for c, k in out.dtypes if k in ("int", "bigint", "double") and c != "o_orderkey"]
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.max(F.lit(len(numeric)).cast("long")).alias("n_features"))


@query("prepare", """SELECT stage, (SELECT count(*) FROM orders)::BIGINT AS n_rows FROM (VALUES ('cleaned'), ('transformed'), ('engineered'), ('vectors')) t(stage)
UNION ALL SELECT 'test', ceil(count(*) * 0.2::DOUBLE)::BIGINT FROM orders UNION ALL SELECT 'train', count(*) - ceil(count(*) * 0.2::DOUBLE)::BIGINT FROM orders""")
def prepare(spark, d):
    """All stages on orders with duplicates: rows of each stage's table."""
    o = load(spark, d, "orders")
    r = flows.prepare(o.unionByName(o.where("o_orderkey % 10 = 0")), ["o_orderkey"], "o_orderstatus")
    out = r.parts.groupBy(F.col("part").alias("stage")).agg(F.count("*").alias("n_rows"))
    for name, t in (("cleaned", r.cleaned), ("transformed", r.transformed), ("engineered", r.engineered), ("vectors", r.vectors)):
        out = out.unionByName(t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows"))
    return out
