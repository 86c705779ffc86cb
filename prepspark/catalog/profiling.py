"""Profile and role queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import (
    GAP_COLUMNS, GAPS, NUM4, SCHEMAS, gaps, load, profile_sql, query, rnd, round_doubles, tables_union, union_all,
)
from prepspark.catalog.features import _DATE_TEXTS, date_texts
from prepspark.operators import profile as P

_ROLE_TABLES = ["orders", "events", "documents"]
_NAMES = ", ".join(f"'{n}'" for n in P.TARGET_NAMES)
_REPORT_NAMES = ", ".join(f"'{n}'" for n in P.REPORT_TARGET_NAMES)
_BY_NAME = "regexp_matches(lower(name), '(^|_)(id|index|key|uuid|guid)(_|$)')"
_ID = f"({_BY_NAME} OR (kind = 'string' AND nd = n))"


def _with_table(sql_of, tables: list[str]) -> str:
    return union_all([f"SELECT *, '{t}' AS \"table\" FROM ({sql_of(t)})" for t in tables])


@query("profile_overview", f"""WITH g AS ({GAPS})
SELECT 'rows' AS item, count(*)::BIGINT AS value FROM g
UNION ALL SELECT 'columns', 10 UNION ALL SELECT 'cells', count(*) * 10 FROM g
UNION ALL SELECT 'missing_cells', sum(({' + '.join(f'({c} IS NULL)::BIGINT' for c in GAP_COLUMNS)}))::BIGINT FROM g
UNION ALL SELECT 'dtype:bigint', 3 UNION ALL SELECT 'dtype:int', 1 UNION ALL SELECT 'dtype:double', 4
UNION ALL SELECT 'dtype:string', 2""")
def profile_overview(spark, d):
    return P.profile_overview(gaps(spark, d)).where("item <> 'bytes'")


_MISSING = f"WITH g AS ({GAPS}), m AS (" + union_all([
    f"SELECT {i} AS ord, '{c}' AS \"column\", (count(*) - count({c}))::BIGINT AS missing, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM g"
    for i, c in enumerate(GAP_COLUMNS)
]) + ")\n"


@query("profile_missing", _MISSING + 'SELECT "column", missing, missing_pct FROM m')
def profile_missing(spark, d):
    return round_doubles(P.profile_missing(gaps(spark, d)))


@query("top_missing", _MISSING + 'SELECT "column", missing, missing_pct FROM m WHERE missing > 0 ORDER BY missing DESC, "column" LIMIT 5')
def top_missing(spark, d):
    return round_doubles(P.top_missing(gaps(spark, d)))


@query("high_missing", _MISSING + 'SELECT "column", missing, missing_pct FROM m WHERE missing_pct > 30 ORDER BY ord')
def high_missing(spark, d):
    return round_doubles(P.high_missing(gaps(spark, d)))


_TYPES = {"numeric": "bigint", "string": "string", "datetime": "timestamp_ntz"}
_ITEM_TYPES = {**{c: "double" for c in NUM4}, "l_linenumber": "int"}


@query("profile_distinct", union_all([
    f"SELECT '{c}' AS \"column\", '{_ITEM_TYPES.get(c, _TYPES[k])}' AS dtype, count(DISTINCT {c})::BIGINT AS distinct_values FROM lineitem"
    for c, k in SCHEMAS["lineitem"]
]))
def profile_distinct(spark, d):
    return P.profile_distinct(load(spark, d, "lineitem"))


def _roles_sql(t: str) -> str:
    return f"""WITH p AS ({profile_sql(t)})
SELECT name AS "column", 'numeric' AS role FROM p WHERE kind = 'numeric'
UNION ALL SELECT name, 'binary' FROM p WHERE kind = 'numeric' AND nd = 2
UNION ALL SELECT name, CASE WHEN len > 20 AND nd > 0.1 * n AND nd > 10 THEN 'text' ELSE 'categorical' END FROM p WHERE kind = 'string'
UNION ALL SELECT name, 'datetime' FROM p WHERE kind = 'datetime'
UNION ALL SELECT name, 'id_like' FROM p WHERE {_ID}"""


@query("profile_roles", _with_table(_roles_sql, _ROLE_TABLES))
def profile_roles(spark, d):
    return tables_union(lambda t: P.profile_roles(load(spark, d, t)), _ROLE_TABLES)


def _parsed_sql(t: str) -> str:
    strings = [c for c, k in SCHEMAS[t] if k == "string"]
    return union_all([
        f"SELECT '{c}' AS name, bool_and({c} IS NULL OR try_cast(trim({c}) AS TIMESTAMP) IS NOT NULL) AND count({c}) > 0 AS parsed FROM {t}"
        for c in strings
    ])


def _runner_sql(t: str) -> str:
    return f"""WITH p0 AS ({profile_sql(t)}), d AS ({_parsed_sql(t)}), p AS (
SELECT p0.*, coalesce(d.parsed, false) OR kind = 'datetime' AS is_dt,
  kind = 'string' AND missing < n AND (nd > 0.1 * n OR len > 20 OR regexp_matches(lower(p0.name), 'text|desc|review|comment')) AS is_text,
  regexp_matches(lower(p0.name), 'id|index|key') OR nd = n AS is_id FROM p0 LEFT JOIN d USING (name))
SELECT name AS "column", 'numeric' AS role FROM p WHERE kind = 'numeric'
UNION ALL SELECT name, 'categorical' FROM p WHERE kind = 'string' AND NOT is_text AND NOT is_dt AND nd <> 2 AND NOT is_id
UNION ALL SELECT name, 'text' FROM p WHERE is_text
UNION ALL SELECT name, 'datetime' FROM p WHERE is_dt
UNION ALL SELECT name, 'binary' FROM p WHERE nd = 2
UNION ALL SELECT name, 'id_like' FROM p WHERE is_id"""


@query("profile_runner_roles", _with_table(_runner_sql, _ROLE_TABLES))
def profile_runner_roles(spark, d):
    return tables_union(lambda t: P.profile_runner_roles(load(spark, d, t)), _ROLE_TABLES)


def _text_sql(t: str) -> str:
    rules = {
        "a": "len > 20 AND nd > 0.5 * n", "b": "len > 20 AND nd > 0.1 * n", "c": "nd > 10 AND len > 20 AND nd > 0.1 * n",
        "d": "len > 20",
        "e": "missing < n AND (nd > 0.1 * n OR len > 20 OR regexp_matches(lower(name), 'text|desc|review|comment'))",
    }
    return f"WITH p AS ({profile_sql(t)})\n" + union_all([
        f"SELECT name AS \"column\", '{r}' AS rule, ({cond}) AS is_text FROM p WHERE kind = 'string'" for r, cond in rules.items()
    ])


_TEXT_TABLES = ["documents", "events", "conversations"]


@query("detect_text", _with_table(_text_sql, _TEXT_TABLES))
def detect_text(spark, d):
    return tables_union(lambda t: P.detect_text(load(spark, d, t)), _TEXT_TABLES)


@query("detect_id_like", _with_table(lambda t: f"""WITH p AS ({profile_sql(t)})
SELECT name AS "column", {_ID} AS id_like, regexp_matches(lower(name), 'id|index|key') OR nd = n AS id_like_substring FROM p""", _ROLE_TABLES))
def detect_id_like(spark, d):
    return tables_union(lambda t: P.detect_id_like(load(spark, d, t)), _ROLE_TABLES)


@query("detect_datetime", """WITH t AS (SELECT o_orderdate AS placed, strftime(o_orderdate, '%Y-%m-%d') AS placed_text,
  CASE WHEN o_orderkey = 7 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS broken_text, o_orderpriority AS priority FROM orders)
SELECT 'placed' AS "column", 'typed' AS source
UNION ALL SELECT 'placed_text', 'parsed' FROM (SELECT bool_and(try_cast(placed_text AS TIMESTAMP) IS NOT NULL) AS ok FROM t) WHERE ok
UNION ALL SELECT 'broken_text', 'parsed' FROM (SELECT bool_and(try_cast(broken_text AS TIMESTAMP) IS NOT NULL) AS ok FROM t) WHERE ok
UNION ALL SELECT 'priority', 'parsed' FROM (SELECT bool_and(try_cast(priority AS TIMESTAMP) IS NOT NULL) AS ok FROM t) WHERE ok""")
def detect_datetime(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = load(spark, d, "orders").select(
        F.col("o_orderdate").alias("placed"), text.alias("placed_text"),
        F.when(F.col("o_orderkey") == 7, "n/a").otherwise(text).alias("broken_text"), F.col("o_orderpriority").alias("priority"),
    )
    return P.detect_datetime(t)


_DATE_KINDS = {"us": ["%m/%d/%Y", "%d/%m/%Y"], "eu": ["%m/%d/%Y", "%d/%m/%Y"], "named": ["%b %d, %Y"], "compact": ["%Y%m%d"], "mixed": ["%Y-%m-%d", "%d.%m.%Y", "%m.%d.%Y"]}


@query("detect_datetime_formats", f"WITH {_DATE_TEXTS} " + union_all([
    f"""SELECT '{c}' AS "column", 'parsed' AS source FROM (SELECT 1 FROM t HAVING {' OR '.join(f"bool_and(try_strptime({c}, '{f}') IS NOT NULL)" for f in formats)})"""
    for c, formats in _DATE_KINDS.items()]))
def detect_datetime_formats(spark, d):
    return P.detect_datetime(date_texts(load(spark, d, "orders")).drop("o_orderkey"))


def _first(cond: str) -> str:
    return f"(SELECT name FROM p WHERE {cond} ORDER BY ord LIMIT 1)"


def _target_sql(t: str) -> str:
    last = "ord = (SELECT max(ord) FROM p)"
    named = _first(f"lower(name) IN ({_NAMES})")
    report = "nd = 2 OR (nd BETWEEN 3 AND 20 AND (kind = 'string' OR nd < 0.1 * n))"
    chains = {
        "transform": [named, _first("nd = 2"), _first(f"{last} AND nd < 0.5 * n")],
        "features": [named, _first("nd = 2 AND kind = 'numeric'"), _first(f"{last} AND nd < 0.5 * n")],
        "runner": [named, _first("nd = 2 AND kind = 'numeric'"), _first(f"{last} AND nd < 0.5 * n"), _first("nd BETWEEN 2 AND 10")],
        "report": [_first(f"lower(name) IN ({_REPORT_NAMES})"), _first(report), _first(f"{last} AND nd <= 20")],
    }
    return f"WITH p AS ({profile_sql(t)})\n" + union_all([
        f"SELECT '{v}' AS variant, coalesce({', '.join(c)}) AS target" for v, c in chains.items()
    ])


_TARGET_TABLES = ["orders", "lineitem", "events", "labels"]


@query("detect_target", _with_table(_target_sql, _TARGET_TABLES))
def detect_target(spark, d):
    return tables_union(lambda t: P.detect_target(load(spark, d, t)), _TARGET_TABLES)


@query("target_candidates", _with_table(lambda t: f"""WITH p AS ({profile_sql(t)}), k AS (SELECT name, CASE
  WHEN nd = 2 AND NOT {_ID} THEN 'binary' WHEN nd BETWEEN 3 AND 20 AND NOT {_ID} THEN 'multiclass'
  WHEN nd > 20 AND kind = 'numeric' THEN 'regression' END AS target_kind FROM p)
SELECT name AS "column", target_kind FROM k WHERE target_kind IS NOT NULL""", _TARGET_TABLES))
def target_candidates(spark, d):
    return tables_union(lambda t: P.target_candidates(load(spark, d, t)), _TARGET_TABLES)


def _kind_sql(t: str, target: str) -> str:
    """``target`` is the column the transform rule picks on the given tables; its classes are counted in SQL."""
    return f"""WITH p AS ({profile_sql(t)}), c AS (SELECT {target} AS v, count(*) AS n FROM {t} GROUP BY 1), f AS (
SELECT bool_or(kind = 'string' AND len > 20 AND nd > 0.5 * n) AS has_text, bool_or(kind = 'numeric') AS has_numeric,
  bool_or(kind = 'string') AS has_categorical, bool_or(kind = 'datetime') AS has_datetime, bool_or(missing > 0) AS has_missing FROM p)
SELECT CASE WHEN has_text AND NOT has_numeric THEN 'text' WHEN has_datetime THEN 'time_series'
    WHEN has_numeric AND has_categorical THEN 'mixed' ELSE 'tabular' END AS kind,
  has_text, has_numeric, has_categorical, has_datetime, has_missing,
  coalesce({_first(f"lower(name) IN ({_NAMES})")}, {_first("nd = 2")}, {_first("ord = (SELECT max(ord) FROM p) AND nd < 0.5 * n")}) AS target,
  (SELECT count(*) <= 10 AND max(n) / min(n) > 5 FROM c) AS is_imbalanced FROM f"""


_KINDS = {"lineitem": "l_linestatus", "events": "value", "labels": "quality", "orders": "o_orderpriority"}


@query("detect_dataset_kind", union_all([f"SELECT *, '{t}' AS \"table\" FROM ({_kind_sql(t, c)})" for t, c in _KINDS.items()]))
def detect_dataset_kind(spark, d):
    return tables_union(lambda t: P.detect_dataset_kind(load(spark, d, t)), list(_KINDS))


_CELLS = " + ".join(f"({c} IS NULL)::BIGINT" for c in GAP_COLUMNS)


@query("quality_score", f"""WITH g AS ({GAPS}), s AS (SELECT count(*)::BIGINT AS row_count, 10 AS column_count,
  sum({_CELLS})::BIGINT AS missing_values FROM g), c AS (
SELECT *, (row_count * 10 - missing_values) * 100.0::DOUBLE / (row_count * 10) AS completeness FROM s)
SELECT row_count, column_count, missing_values, round(completeness, 6) AS completeness, floor(completeness)::INTEGER AS quality_score,
  CASE WHEN completeness > 90 THEN 'excellent' WHEN completeness > 75 THEN 'good' ELSE 'needs_attention' END AS status FROM c""")
def quality_score(spark, d):
    return round_doubles(P.quality_score(gaps(spark, d)))


_SKEWED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("advise", f"""WITH g AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM ({GAPS})),
m AS (SELECT count(*) AS n, 100.0 * sum({' + '.join(f'({c} IS NULL)::BIGINT' for c in [*NUM4, 'l_returnflag', 'l_linestatus'])}) / (count(*) * 6) AS pct FROM g),
s AS ({union_all([f"SELECT skewness({c}) AS v FROM g" for c in _SKEWED])}),
d AS (SELECT count(DISTINCT l_returnflag) AS v FROM g UNION ALL SELECT count(DISTINCT l_linestatus) FROM g),
r AS (
SELECT 'shape' AS topic, 'rows' AS rule, n::DOUBLE AS value FROM m UNION ALL SELECT 'shape', 'columns', 6
UNION ALL SELECT 'missing', CASE WHEN pct > 30 THEN 'high' WHEN pct > 5 THEN 'moderate' ELSE 'low' END, pct FROM m
UNION ALL SELECT 'dtype', 'double', 4 UNION ALL SELECT 'dtype', 'string', 2
UNION ALL SELECT 'skew', 'min', min(v) FROM s UNION ALL SELECT 'skew', 'max', max(v) FROM s
UNION ALL SELECT 'scaling', CASE WHEN max(abs(v)) > 2 THEN 'robust_or_log' WHEN max(abs(v)) > 1 THEN 'robust' ELSE 'standard' END, max(abs(v)) FROM s
UNION ALL SELECT 'cardinality', 'min', min(v) FROM d UNION ALL SELECT 'cardinality', 'max', max(v) FROM d
UNION ALL SELECT 'encoding', CASE WHEN count(*) FILTER (v > 10) > 0 THEN 'frequency_or_target' ELSE 'onehot' END, count(*) FILTER (v > 10) FROM d
UNION ALL SELECT 'features', 'interactions', 4
UNION ALL SELECT 'recommend', 'impute', pct FROM m WHERE pct > 5
UNION ALL SELECT 'recommend', 'encode', 2
UNION ALL SELECT 'target_share', l_linestatus, count(*) / (SELECT count(*) FROM g)::DOUBLE FROM g GROUP BY l_linestatus)
SELECT topic, rule, round(value::DOUBLE, 6) + 0.0 AS value FROM r""")
def advise(spark, d):
    g = gaps(spark, d).select(*NUM4, "l_returnflag", "l_linestatus")
    return P.advise(g, "l_linestatus").select("topic", "rule", rnd("value"))


@query("validate_nonempty", "SELECT count(*)::BIGINT AS n_rows FROM orders")
def validate_nonempty(spark, d):
    return P.validate_nonempty(load(spark, d, "orders")).agg(F.count("*").alias("n_rows"))
