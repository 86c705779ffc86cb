"""Cleaning, scaling, encoding and binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import DOUBLED, GAP_COLUMNS, GAPS, ITEM_KEYS, NUM4, doubled, gaps, load, query, round_doubles, union_all
from prepspark.operators import bins, clean, encode, scale

_ALL = ", ".join(GAP_COLUMNS)


@query("drop_null_rows", f"SELECT {_ALL} FROM ({GAPS}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in GAP_COLUMNS))
def drop_null_rows(spark, d):
    return clean.drop_null_rows(gaps(spark, d))


def _filled(how: str) -> str:
    cols = ", ".join(
        f"round(coalesce({c}, (SELECT {how.format(c=c)} FROM g)), 6) AS {c}" if c in ("l_quantity", "l_tax") else c for c in GAP_COLUMNS
    )
    return f"WITH g AS ({GAPS}) SELECT {cols} FROM g"


@query("impute_mean", _filled("avg({c})"))
def impute_mean(spark, d):
    return clean.impute_mean(gaps(spark, d), ["l_quantity", "l_tax"]).select(
        *[F.round(c, 6).alias(c) if c in ("l_quantity", "l_tax") else c for c in GAP_COLUMNS]
    )


@query("impute_median", _filled("median({c})"))
def impute_median(spark, d):
    return clean.impute_median(gaps(spark, d), ["l_quantity", "l_tax"]).select(
        *[F.round(c, 6).alias(c) if c in ("l_quantity", "l_tax") else c for c in GAP_COLUMNS]
    )


_MODE = "(SELECT l_returnflag FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_returnflag LIMIT 1)"


@query("impute_mode", f"""WITH g AS ({GAPS})
SELECT {', '.join(f'coalesce(l_returnflag, {_MODE}) AS l_returnflag' if c == 'l_returnflag' else c for c in GAP_COLUMNS)} FROM g""")
def impute_mode(spark, d):
    return clean.impute_mode(gaps(spark, d))


_KEPT = [c for c in GAP_COLUMNS if c != "l_tax"]


@query("drop_sparse_columns", f"SELECT {', '.join(_KEPT)} FROM ({GAPS})")
def drop_sparse_columns(spark, d):
    return clean.drop_sparse_columns(gaps(spark, d))


_AUTO = {"l_quantity": "coalesce(l_quantity, (SELECT median(l_quantity) FROM g)) AS l_quantity", "l_returnflag": f"coalesce(l_returnflag, {_MODE}) AS l_returnflag"}


@query("impute_auto", f"WITH g AS ({GAPS}) SELECT {', '.join(_AUTO.get(c, c) for c in _KEPT)} FROM g")
def impute_auto(spark, d):
    return clean.handle_missing(gaps(spark, d), "auto")


@query("dedup_rows", f"SELECT DISTINCT * FROM ({DOUBLED})")
def dedup_rows(spark, d):
    return clean.dedup_rows(doubled(spark, d))


@query("cast_columns", """SELECT o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority, substr(o_orderpriority, 1, 1)::INTEGER AS urgency, CASE WHEN o_orderkey = 3 THEN 'x' ELSE '1' END AS broken FROM orders""")
def cast_columns(spark, d):
    o = load(spark, d, "orders").withColumns({
        "urgency": F.substring("o_orderpriority", 1, 1), "broken": F.when(F.col("o_orderkey") == 3, "x").otherwise("1"),
    })
    return clean.cast_columns(o, {"o_custkey": "int", "urgency": "int", "broken": "int"})


@query("clean_policy", f"""WITH g AS ({GAPS}), u AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE l_orderkey % 10 = 0)
SELECT DISTINCT * REPLACE (l_suppkey::INTEGER AS l_suppkey) FROM u WHERE {' AND '.join(f'{c} IS NOT NULL' for c in GAP_COLUMNS)}""")
def clean_policy(spark, d):
    g = gaps(spark, d)
    return clean.clean_policy(g.unionByName(g.where("l_orderkey % 10 = 0")), "mean", True, {"l_suppkey": "int"})


_NUMERIC_GAPS = [c for c in GAP_COLUMNS if c != "l_returnflag"]


@query("clean_policy_numeric_gaps", f"""WITH g AS ({GAPS}), u AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE l_orderkey % 10 = 0)
SELECT DISTINCT {', '.join(f'round(coalesce({c}, (SELECT avg({c}) FROM u)), 6) AS {c}' if c in ('l_quantity', 'l_tax') else c for c in _NUMERIC_GAPS)} FROM u""")
def clean_policy_numeric_gaps(spark, d):
    g = gaps(spark, d).drop("l_returnflag")
    out = clean.clean_policy(g.unionByName(g.where("l_orderkey % 10 = 0")))
    return out.select(*[F.round(c, 6).alias(c) if c in ("l_quantity", "l_tax") else c for c in _NUMERIC_GAPS])


@query("drop_nested_columns", "SELECT vec_id, label FROM embeddings")
def drop_nested_columns(spark, d):
    return clean.drop_nested_columns(load(spark, d, "embeddings"))


@query("table_diff", f"""WITH b AS ({DOUBLED}), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice,
  upper(o_orderstatus) AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 4 <> 1),
j AS (SELECT x.o_totalprice IS DISTINCT FROM a.o_totalprice AS d1, x.o_orderstatus IS DISTINCT FROM a.o_orderstatus AS d2,
  x.o_orderpriority IS DISTINCT FROM a.o_orderpriority AS d3 FROM (SELECT DISTINCT * FROM b) x JOIN a USING (o_orderkey))
SELECT 'rows_removed' AS item, ((SELECT count(*) FROM b) - (SELECT count(*) FROM a))::BIGINT AS value
UNION ALL SELECT 'keys_lost', count(*) FROM (SELECT DISTINCT o_orderkey FROM b) k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
UNION ALL SELECT 'keys_new', 0 UNION ALL SELECT 'columns_lost', 2
UNION ALL SELECT 'different_cells', sum(d1::INT + d2::INT + d3::INT)::BIGINT FROM j
UNION ALL SELECT 'different:o_totalprice', sum(d1::INT)::BIGINT FROM j UNION ALL SELECT 'different:o_orderstatus', sum(d2::INT)::BIGINT FROM j
UNION ALL SELECT 'different:o_orderpriority', sum(d3::INT)::BIGINT FROM j""")
def table_diff(spark, d):
    after = load(spark, d, "orders").where("o_orderkey % 4 <> 1").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.upper("o_orderstatus").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return clean.table_diff(doubled(spark, d), after, ["o_orderkey"])


@query("table_diff_repeats", f"""WITH b AS ({DOUBLED}), a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM b UNION ALL
SELECT o_orderkey, o_custkey + 1, o_orderstatus FROM orders WHERE o_orderkey % 10 = 3), n AS (SELECT count(*) FILTER (o_orderkey % 10 = 3) AS k FROM orders),
c AS (SELECT o_orderkey, 0 - o_custkey - 1 AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM a)
SELECT 'rows_removed' AS item, (0 - (SELECT k FROM n))::BIGINT AS value UNION ALL SELECT 'keys_lost', 0 UNION ALL SELECT 'keys_new', 0 UNION ALL SELECT 'columns_lost', 3
UNION ALL SELECT 'different_cells', count(*) FILTER (o_orderkey % 10 = 0) FROM orders UNION ALL SELECT 'different:o_custkey', count(*) FILTER (o_orderkey % 10 = 0) FROM orders
UNION ALL SELECT 'different:o_orderstatus', 0""")
def table_diff_repeats(spark, d):
    """Keys with two rows: one of a pair is changed, and elsewhere a second row is added."""
    b = doubled(spark, d)
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")))
    again = o.where("o_orderkey % 10 = 0")
    extra = o.where("o_orderkey % 10 = 3").withColumn("o_custkey", F.col("o_custkey") + 1)
    return clean.table_diff(b, changed.unionByName(again).unionByName(extra), ["o_orderkey"])


# ---- scaling ---------------------------------------------------------------------------------------

def _scaled(expr: str, cols: list[str] = NUM4) -> str:
    made = ", ".join(f"round({expr.format(c=c)}, 6) + 0.0 AS {c}" for c in cols)
    return f"SELECT {', '.join(ITEM_KEYS)}, {made} FROM lineitem"


def _items(spark, d):
    return load(spark, d, "lineitem").select(*ITEM_KEYS, *NUM4)


@query("scale_minmax", _scaled("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)"))
def scale_minmax(spark, d):
    return round_doubles(scale.scale_minmax(_items(spark, d), NUM4))


@query("scale_standard", _scaled("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def scale_standard(spark, d):
    return round_doubles(scale.scale_standard(_items(spark, d), NUM4))


_ROBUST = "({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"


@query("scale_robust", _scaled(_ROBUST))
def scale_robust(spark, d):
    return round_doubles(scale.scale_robust(_items(spark, d), NUM4))


@query("scale_auto", """WITH s AS (SELECT (abs(skewness(value)) > 1)::INT + (abs(skewness(user_id)) > 1)::INT AS wide FROM events)
SELECT event_id, 'both' AS cols,
  round(CASE WHEN wide > 1 THEN (value - (SELECT median(value) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events)
    ELSE (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) END, 6) + 0.0 AS value FROM events, s
UNION ALL SELECT event_id, 'value',
  round(CASE WHEN (SELECT abs(skewness(value)) > 1 FROM events) THEN (value - (SELECT median(value) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events)
    ELSE (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) END, 6) + 0.0 FROM events""")
def scale_auto(spark, d):
    e = load(spark, d, "events")
    both = scale.scale_normalize(e, "auto", ["value", "user_id"]).select("event_id", F.lit("both").alias("cols"), "value")
    one = scale.scale_normalize(e, "auto", ["value"]).select("event_id", F.lit("value").alias("cols"), "value")
    return round_doubles(both.unionByName(one))


# ---- encoding --------------------------------------------------------------------------------------

@query("encode_binary", f"SELECT {', '.join(ITEM_KEYS)}, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS l_linestatus FROM lineitem")
def encode_binary(spark, d):
    return encode.encode_binary(load(spark, d, "lineitem").select(*ITEM_KEYS, "l_linestatus"), "l_linestatus")


@query("encode_label", """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part))
SELECT p_partkey, p_brand, code AS p_brand_encoded FROM part JOIN c ON p_brand = v""")
def encode_label(spark, d):
    return encode.encode_label(load(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_brand_encoded")


@query("encode_label_shuffled", """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_name AS v FROM customer))
SELECT c_custkey, code AS c_name FROM customer JOIN c ON c_name = v""")
def encode_label_shuffled(spark, d):
    return encode.encode_label(load(spark, d, "customer").select("c_custkey", "c_name"), "c_name", max_rows=100)


_FLAGS = ", ".join(f"coalesce((l_returnflag = '{v}')::INTEGER, 0) AS l_returnflag_{v}" for v in "NR")


@query("encode_onehot", f"SELECT {', '.join(ITEM_KEYS)}, {_FLAGS} FROM ({GAPS})")
def encode_onehot(spark, d):
    return encode.encode_onehot(gaps(spark, d).select(*ITEM_KEYS, "l_returnflag"), "l_returnflag")


@query("encode_frequency", """WITH c AS (SELECT p_name AS v, count(*) / (SELECT count(*) FROM part)::DOUBLE AS f FROM part GROUP BY 1)
SELECT p_partkey, round(f, 6) AS p_name FROM part JOIN c ON p_name = v""")
def encode_frequency(spark, d):
    return round_doubles(encode.encode_frequency(load(spark, d, "part").select("p_partkey", "p_name"), "p_name"))


@query("encode_target_mean", """SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS c_mktsegment_target_mean FROM customer""")
def encode_target_mean(spark, d):
    out = encode.encode_target_mean(load(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return round_doubles(out.select("c_custkey", "c_mktsegment_target_mean"))


@query("encode_target_mean_folds", """WITH c AS (SELECT *, (c_custkey % 3)::INTEGER AS fold FROM customer), s AS (
SELECT fold, c_mktsegment, sum(c_acctbal) AS s, count(*) AS n FROM c GROUP BY 1, 2), t AS (
SELECT c_mktsegment, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
SELECT c_custkey, round((t.s - s.s) / (t.n - s.n), 7) AS encoded FROM c JOIN s USING (fold, c_mktsegment) JOIN t USING (c_mktsegment)""")
def encode_target_mean_folds(spark, d):
    c = load(spark, d, "customer").withColumn("fold", (F.col("c_custkey") % 3).cast("int"))
    out = encode.encode_target_mean(c, "c_mktsegment", "c_acctbal", "encoded", fold="fold")
    return round_doubles(out.select("c_custkey", "encoded"), 7)


@query("encode_target_prob", """WITH p AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2), q AS (
SELECT o_orderpriority, max(c) / sum(c)::DOUBLE AS prob FROM p GROUP BY 1)
SELECT o_orderkey, round(prob, 6) AS o_orderpriority_target_prob FROM orders JOIN q USING (o_orderpriority)""")
def encode_target_prob(spark, d):
    out = encode.encode_target_prob(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return round_doubles(out.select("o_orderkey", "o_orderpriority_target_prob"))


_TYPES = ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("encode_auto", f"""WITH b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part)),
f AS (SELECT p_name AS v, count(*) / (SELECT count(*) FROM part)::DOUBLE AS share FROM part GROUP BY 1)
SELECT p_partkey, round(share, 6) AS p_name, code AS p_brand, p_size, p_retailprice, (p_size > 25)::INTEGER AS large,
  {', '.join(f"(p_type = '{t}')::INTEGER AS p_type_{t}" for t in _TYPES)}
FROM part JOIN b ON p_brand = b.v JOIN f ON p_name = f.v""")
def encode_auto(spark, d):
    p = load(spark, d, "part").withColumn("large", F.when(F.col("p_size") > 25, "yes").otherwise("no"))
    return round_doubles(encode.encode_categorical(p))


@query("categorical_features", f"""WITH b AS (SELECT p_brand AS v, count(*) / (SELECT count(*) FROM part)::DOUBLE AS f, avg(p_retailprice) AS m,
  row_number() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY 1), t AS (
SELECT p_type AS v, count(*) / (SELECT count(*) FROM part)::DOUBLE AS f, avg(p_retailprice) AS m, row_number() OVER (ORDER BY p_type) - 1 AS code FROM part GROUP BY 1)
SELECT p_partkey, p_brand, p_type, round(p_retailprice, 6) AS p_retailprice, b.code AS p_brand_encoded, round(b.f, 6) AS p_brand_freq, round(b.m, 6) AS p_brand_target_mean,
  t.code AS p_type_encoded, round(t.f, 6) AS p_type_freq, round(t.m, 6) AS p_type_target_mean,
  {', '.join(f"(p_type = '{x}')::INTEGER AS p_type_{x}" for x in _TYPES)}
FROM part JOIN b ON p_brand = b.v JOIN t ON p_type = t.v""")
def categorical_features(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return round_doubles(encode.categorical_features(p, ["p_brand", "p_type"], "p_retailprice"))


# ---- binning ---------------------------------------------------------------------------------------

def _bins_case(edges: str, n: int = 5) -> str:
    """Bin as a sum of comparisons with the interior edges; an edge equal to the one before counts once."""
    ctes, made = [], []
    for c in NUM4:
        es = ", ".join(f"{edges.format(c=c, i=i, n=n)} AS e{i}" for i in range(n + 1))
        ctes.append(f"e_{c} AS (SELECT {es} FROM lineitem)")
        terms = [f"({c} >= e_{c}.e{i} AND e_{c}.e{i} - e_{c}.e{i - 1} > 1e-8 AND e_{c}.e{n} - e_{c}.e{i} > 1e-8)::INTEGER" for i in range(1, n)]
        made.append(f"({' + '.join(terms)}) AS {c}")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(ITEM_KEYS)}, {', '.join(made)} FROM lineitem, " + ", ".join(f"e_{c}" for c in NUM4)


@query("bin_quantile", _bins_case("quantile_cont({c}, {i} / {n}.0)"))
def bin_quantile(spark, d):
    return bins.bin_quantile(_items(spark, d), NUM4)


@query("bin_uniform", _bins_case("min({c}) + (max({c}) - min({c})) * {i} / {n}"))
def bin_uniform(spark, d):
    return bins.bin_uniform(_items(spark, d), NUM4)


@query("bin_kmeans", union_all([
    f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_rows, 5::BIGINT AS n_bins, true AS ordered, true AS nearest FROM lineitem" for c in NUM4
]))
def bin_kmeans(spark, d):
    """Checks that bins are disjoint value ranges and that every value is nearest to its own bin's mean."""
    items = _items(spark, d)
    binned = items.select(*NUM4, *[b.alias(f"b_{c}") for c, b in ((c, bins.bin_expr(c, e)) for c, e in bins.kmeans_edges(items, NUM4).items())])
    tall = binned.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("x"), F.col(f"b_{c}").alias("b")) for c in NUM4
    ])).alias("r")).select("r.*")
    per_bin = tall.groupBy("column", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"))
    bins_list = F.sort_array(F.collect_list(F.struct("b", "lo", "hi", "m")))
    per_col = per_bin.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_bins"), bins_list.alias("bs"))
    pairs = F.arrays_zip(F.slice("bs", 1, 4).alias("p"), F.slice("bs", 2, 4).alias("q"))
    mid = lambda z: (z["p"]["m"] + z["q"]["m"]) / 2
    return per_col.select(
        "column", "n_rows", "n_bins", F.forall(pairs, lambda z: z["p"]["hi"] < z["q"]["lo"]).alias("ordered"),
        F.forall(pairs, lambda z: (z["p"]["hi"] <= mid(z) + 0.01 * (z["q"]["m"] - z["p"]["m"])) & (z["q"]["lo"] >= mid(z) - 0.01 * (z["q"]["m"] - z["p"]["m"]))).alias("nearest"),
    )
