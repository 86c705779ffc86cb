"""Distribution, association and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import GAPS, ITEM_KEYS, NUM4, gaps, load, query, round_doubles, union_all
from prepspark.operators import eda

_CATS = ["l_returnflag", "l_linestatus"]


@query("value_counts", f"WITH g AS ({GAPS})\n" + union_all([
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*)::BIGINT AS n FROM g WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CATS
]))
def value_counts(spark, d):
    return eda.value_counts(gaps(spark, d), max_distinct=15)


@query("target_distribution", """WITH c AS (SELECT quality::VARCHAR AS class, count(*)::BIGINT AS n FROM labels GROUP BY 1)
SELECT class, n, round(n / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share, (SELECT min(n) / sum(n)::DOUBLE < 0.2 FROM c) AS imbalanced FROM c""")
def target_distribution(spark, d):
    return round_doubles(eda.target_distribution(load(spark, d, "labels"), "quality"))


@query("target_summary", """SELECT 'status' AS target, 'class:' || o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'brand', 'class:' || p_brand, count(*)::DOUBLE FROM part GROUP BY p_brand
UNION ALL SELECT 'price', 'mean', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'price', 'std', round(stddev_samp(o_totalprice), 4) FROM orders""")
def target_summary(spark, d):
    o = load(spark, d, "orders")
    a = eda.target_summary(o, "o_orderstatus").withColumn("target", F.lit("status"))
    a = a.unionByName(eda.target_summary(load(spark, d, "part"), "p_brand").withColumn("target", F.lit("brand")))
    return round_doubles(a.unionByName(eda.target_summary(o, "o_totalprice").withColumn("target", F.lit("price"))), 4)


def _hist_sql(c: str, k: int, table: str = "lineitem") -> str:
    return f"""SELECT '{c}' AS "column", b AS bin, lo + (b - 1) * (hi - lo) / {k} AS lo, lo + b * (hi - lo) / {k} AS hi,
  (SELECT count(*) FROM {table} WHERE least(floor(({c} - lo) / (hi - lo) * {k})::INTEGER + 1, {k}) = b) AS n
FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}), (SELECT unnest(range(1, {k} + 1)) AS b)"""


@query("histogram", f"SELECT \"column\", bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n::BIGINT AS n FROM ({union_all([_hist_sql(c, 30) for c in NUM4])})")
def histogram(spark, d):
    return round_doubles(eda.histogram(load(spark, d, "lineitem"), NUM4))


@query("histogram_auto", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
k AS (SELECT lo, hi, greatest(1, ceil((hi - lo) / least(2 * iqr / n ** (1 / 3.0), (hi - lo) / (log2(n) + 1))))::INTEGER AS k FROM s),
c AS (SELECT least(floor((value - lo) / (hi - lo) * k)::INTEGER + 1, k) AS b, count(*) AS n FROM events, k GROUP BY 1)
SELECT 'value' AS "column", g.b AS bin, round(lo + (g.b - 1) * (hi - lo) / k, 6) AS lo, round(lo + g.b * (hi - lo) / k, 6) AS hi, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT lo, hi, k, unnest(range(1, k + 1)) AS b FROM k) g LEFT JOIN c ON c.b = g.b""")
def histogram_auto(spark, d):
    return round_doubles(eda.histogram(load(spark, d, "events"), ["value"], "auto"))


_BOX_COLS = ["value", "user_id"]


@query("box_stats", union_all([
    f"""SELECT '{c}' AS "column", q1, median, q3, min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1))::DOUBLE AS whisker_low,
  max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_high,
  (count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))::BIGINT AS outliers
FROM events, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, median({c})::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM events) GROUP BY q1, median, q3"""
    for c in _BOX_COLS
]))
def box_stats(spark, d):
    return eda.box_stats(load(spark, d, "events"), _BOX_COLS)


@query("density", """WITH s AS (SELECT stddev_samp(value) * count(value) ** (-0.2) AS bw, min(value) AS lo, max(value) AS hi, count(value)::DOUBLE AS total FROM events),
g AS (SELECT *, lo - 3 * bw + ((hi + 3 * bw) - (lo - 3 * bw)) * unnest(range(0, 50)) / 49 AS x FROM (SELECT bw, lo, hi, total FROM s))
SELECT 'value' AS "column", round(x, 5) AS x, round(sum(exp(-(((x - value) / bw) ** 2) / 2)) / (total * bw * sqrt(2 * pi())), 8) AS density
FROM events, g WHERE value IS NOT NULL GROUP BY x, total, bw""")
def density(spark, d):
    """Held against the exact kernel sum over all values."""
    out = eda.density(load(spark, d, "events"), ["value"])
    return out.select("column", F.round("x", 5).alias("x"), F.round("density", 8).alias("density"))


def _corr_rows(cols: list[str], table: str) -> str:
    return union_all([
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {table}" for a in cols for b in cols if a != b
    ] + [f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in cols])


@query("corr_matrix", f"WITH g AS ({GAPS}) SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_corr_rows(NUM4, 'g')})")
def corr_matrix(spark, d):
    return round_doubles(eda.corr_matrix(gaps(spark, d), NUM4))


_DERIVED = "SELECT l_quantity AS qty, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, l_quantity * 2 AS twice, 1 AS one FROM lineitem"
_DCOLS = ["qty", "price", "net", "gross", "twice"]


@query("high_corr_pairs", "WITH t AS (" + _DERIVED + ") SELECT a, b, round(r, 6) AS r FROM (" + union_all([
    f"SELECT {i * 10 + j} AS pos, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM t" for i, a in enumerate(_DCOLS) for j, b in enumerate(_DCOLS) if i < j
]) + ") WHERE abs(r) > 0.8 ORDER BY pos")
def high_corr_pairs(spark, d):
    item = load(spark, d, "lineitem")
    p = F.col("l_extendedprice")
    t = item.select(
        F.col("l_quantity").alias("qty"), p.alias("price"), (p * (1 - F.col("l_discount"))).alias("net"), (p * (1 + F.col("l_tax"))).alias("gross"),
        (F.col("l_quantity") * 2).alias("twice"), F.lit(1).alias("one"),
    )
    return round_doubles(eda.high_corr_pairs(t))


def _chi_sql(c: str, t: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN dof = 1 THEN sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2, dof FROM (
SELECT x.r * y.c / t.n::DOUBLE AS e, coalesce(k.o, 0) AS o, ((SELECT count(DISTINCT {c}) FROM {table}) - 1) * ((SELECT count(DISTINCT {t}) FROM {table}) - 1) AS dof
FROM (SELECT {c} AS a, count(*) AS r FROM {table} GROUP BY 1) x CROSS JOIN (SELECT {t} AS b, count(*) AS c FROM {table} GROUP BY 1) y
CROSS JOIN (SELECT count(*) AS n FROM {table}) t LEFT JOIN (SELECT {c} AS a, {t} AS b, count(*) AS o FROM {table} GROUP BY 1, 2) k ON k.a = x.a AND k.b = y.b) GROUP BY dof"""


@query("chi_square", "WITH t AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size FROM orders)\n"
       + "SELECT \"column\", round(chi2, 6) AS chi2, dof::BIGINT AS dof FROM (" + union_all([_chi_sql(c, "o_orderstatus", "t") for c in ("o_orderpriority", "size")]) + ")")
def chi_square(spark, d):
    o = load(spark, d, "orders")
    t = o.select("o_orderstatus", "o_orderpriority", F.when(F.col("o_totalprice") > 250000, "big").otherwise("small").alias("size"))
    return round_doubles(eda.chi_square(t, "o_orderstatus", with_p=False))


_P_EVEN = "exp(-chi2 / 2) * list_sum(list_transform(range(0, (dof // 2)::INTEGER), lambda i: (chi2 / 2) ** i / gamma(i + 1.0)))"


@query("chi_square_p", f"""WITH t AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size FROM orders), c AS (
{union_all([_chi_sql(c, "o_orderstatus", "t") for c in ("o_orderpriority", "size")])})
SELECT "column", round(chi2, 6) AS chi2, dof::BIGINT AS dof, round({_P_EVEN}, 6) + 0.0 AS p_value FROM c""")
def chi_square_p(spark, d):
    """Both columns have an even number of degrees of freedom, for which the tail is a finite sum."""
    o = load(spark, d, "orders")
    t = o.select("o_orderstatus", "o_orderpriority", F.when(F.col("o_totalprice") > 250000, "big").otherwise("small").alias("size"))
    return round_doubles(eda.chi_square(t, "o_orderstatus"))


@query("chi_square_sparse", "SELECT \"column\", round(chi2, 5) AS chi2, dof::BIGINT AS dof FROM (" + union_all([_chi_sql(c, "lang", "documents") for c in ("source",)])
       + " UNION ALL " + _chi_sql("flag", "big", "(SELECT l_returnflag AS flag, l_quantity > 25 AS big FROM lineitem)") + ")")
def chi_square_sparse(spark, d):
    a = eda.chi_square(load(spark, d, "documents"), "lang", ["source"], with_p=False)
    item = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") > 25).alias("big"))
    return round_doubles(a.unionByName(eda.chi_square(item, "big", with_p=False)), 5)


@query("skewness", union_all([f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) + 0.0 AS skew FROM {t}" for c, t in (("value", "events"), ("user_id", "events"), ("event_id", "events"))]))
def skewness(spark, d):
    return round_doubles(eda.skewness(load(spark, d, "events"), ["value", "user_id", "event_id"]))


@query("vif", """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS c FROM lineitem)
SELECT u AS "column", round(1 / (1 - b * b / (a * c)), 6) AS vif FROM g, (VALUES ('l_quantity'), ('l_discount')) t(u)""")
def vif(spark, d):
    """A column with missing cells takes no part."""
    item = load(spark, d, "lineitem").select("l_quantity", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))
    return round_doubles(eda.vif(item))


@query("pair_sample", "SELECT event_id, user_id, value, event_type FROM events")
def pair_sample(spark, d):
    return eda.pair_sample(load(spark, d, "events"), hue="event_type")


_MAPPED = [*NUM4, "l_returnflag", "l_linestatus"]


@query("missing_map", f"WITH g AS ({GAPS})\n" + union_all([
    f"SELECT substr(md5(concat_ws('|', {', '.join(ITEM_KEYS)}, '42')), 1, 1) AS block, '{c}' AS \"column\", round(avg(({c} IS NULL)::INTEGER), 6) AS rate FROM g GROUP BY 1"
    for c in _MAPPED
]))
def missing_map(spark, d):
    return round_doubles(eda.missing_map(gaps(spark, d), ITEM_KEYS))


@query("univariate_columns", union_all([
    f"SELECT '{c}' AS \"column\", '{g}' AS \"group\", count({c})::BIGINT AS n FROM orders" for c, g in (
        ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderstatus", "categorical"), ("o_orderpriority", "categorical"))
]))
def univariate_columns(spark, d):
    return eda.univariate_columns(load(spark, d, "orders"))


@query("eda_report", """WITH t AS (SELECT o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
b AS (SELECT quantile_cont(price, 0.25) AS q1, median(price) AS m, quantile_cont(price, 0.75) AS q3 FROM t), r AS (
SELECT 'overview' AS section, NULL AS "column", 'rows' AS metric, count(*)::DOUBLE AS value FROM t
UNION ALL SELECT 'overview', NULL, 'columns', 3 UNION ALL SELECT 'overview', NULL, 'cells', count(*) * 3 FROM t
UNION ALL SELECT 'overview', NULL, 'missing_cells', 0 UNION ALL SELECT 'overview', NULL, 'dtype:double', 1 UNION ALL SELECT 'overview', NULL, 'dtype:string', 2
UNION ALL SELECT 'missing', unnest(['price', 'status', 'priority']), 'missing', 0
UNION ALL SELECT 'value_counts', 'status', status, count(*) FROM t GROUP BY status
UNION ALL SELECT 'value_counts', 'priority', priority, count(*) FROM t GROUP BY priority
UNION ALL SELECT 'box', 'price', 'q1', q1 FROM b UNION ALL SELECT 'box', 'price', 'median', m FROM b UNION ALL SELECT 'box', 'price', 'q3', q3 FROM b
UNION ALL SELECT 'box', 'price', 'whisker_low', min(price) FROM t, b WHERE price >= q1 - 1.5 * (q3 - q1)
UNION ALL SELECT 'box', 'price', 'whisker_high', max(price) FROM t, b WHERE price <= q3 + 1.5 * (q3 - q1)
UNION ALL SELECT 'box', 'price', 'outliers', count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) FROM t, b
UNION ALL SELECT 'skew', 'price', 'skew', skewness(price) FROM t UNION ALL SELECT 'corr', 'price', 'price', 1 UNION ALL SELECT 'vif', 'price', 'vif', 1
UNION ALL SELECT 'target', 'status', status, count(*) / (SELECT count(*) FROM t)::DOUBLE FROM t GROUP BY status
UNION ALL SELECT 'target_imbalanced', 'status', 'imbalanced', (min(n) / sum(n)::DOUBLE < 0.2)::INTEGER FROM (SELECT count(*) AS n FROM t GROUP BY status)
UNION ALL SELECT 'importance', NULL, 'sum', 1
UNION ALL SELECT 'chi_square', 'priority', 'chi2', chi2 FROM (""" + _chi_sql("priority", "status", "t") + """))
SELECT section, "column", metric, round(value::DOUBLE, 4) + 0.0 AS value FROM r""")
def eda_report(spark, d):
    t = load(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    r = eda.eda_report(t, "status").where("metric <> 'bytes'")
    shares = r.where("section = 'importance'").agg(F.sum("value").alias("value")).select(
        F.lit("importance").alias("section"), F.lit(None).cast("string").alias("column"), F.lit("sum").alias("metric"), "value")
    return round_doubles(r.where("section <> 'importance'").unionByName(shares), 4)
