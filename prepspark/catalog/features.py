"""Row, text, date, selection, projection and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import GAPS, ITEM_KEYS, NUM4, gaps, load, query, rnd, round_doubles, spread, union_all
from prepspark.operators import reduce, rowfeat, select, temporal, text, vector

_K = ", ".join(ITEM_KEYS)


# ---- rows ------------------------------------------------------------------------------------------

_LIST = "list_filter([l_quantity, l_extendedprice, l_discount, l_tax], lambda x: x IS NOT NULL)"


@query("row_stats", f"""WITH g AS (SELECT *, {_LIST} AS v FROM ({GAPS}))
SELECT {_K}, l_extendedprice, round(list_avg(v), 6) AS numeric_mean, round(coalesce(list_stddev_samp(v), 0), 6) AS numeric_std, round(list_sum(v), 6) AS numeric_sum,
  list_min(v) AS numeric_min, list_max(v) AS numeric_max, round(list_max(v) - list_min(v), 6) AS numeric_range FROM g""")
def row_stats(spark, d):
    out = rowfeat.row_stats(gaps(spark, d), NUM4)
    return out.select(
        *ITEM_KEYS, "l_extendedprice", rnd("numeric_mean"), rnd("numeric_std"), rnd("numeric_sum"), "numeric_min", "numeric_max", rnd("numeric_range"),
    )


_NULLS = " + ".join(f"({c} IS NULL)::INTEGER" for c in [*NUM4, "l_returnflag", "l_linestatus", *ITEM_KEYS])


@query("row_missing", f"SELECT {_K}, l_extendedprice, ({_NULLS})::INTEGER AS missing_count, round(({_NULLS}) / 10.0::DOUBLE, 6) AS missing_ratio FROM ({GAPS})")
def row_missing(spark, d):
    return rowfeat.row_missing(gaps(spark, d)).select(*ITEM_KEYS, "l_extendedprice", "missing_count", rnd("missing_ratio"))


_PAIRED = ["l_quantity", "l_discount", "l_tax"]
_INTER = ", ".join(
    f"round({a} * {b}, 6) AS {a}_times_{b}, round({a} / CASE WHEN {b} = 0 THEN 1 ELSE {b} END, 6) AS {a}_div_{b}, "
    f"round({a} + {b}, 6) AS {a}_plus_{b}, round({a} - {b}, 6) + 0.0 AS {a}_minus_{b}"
    for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1:]
)


@query("interactions", f"SELECT {_K}, {', '.join(_PAIRED)}, {_INTER} FROM lineitem")
def interactions(spark, d):
    items = load(spark, d, "lineitem").select(*ITEM_KEYS, *_PAIRED)
    return round_doubles(rowfeat.interactions(items, _PAIRED))


def _poly_sql(cols: list[str]) -> list[str]:
    terms = list(cols)
    terms += [f"{a} * {b}" for i, a in enumerate(cols) for b in cols[i:]]
    return [f"round({t}, 4) AS poly_{i}" for i, t in enumerate(terms)]


@query("polynomial", f"SELECT {_K}, {', '.join(_poly_sql(NUM4))} FROM lineitem")
def polynomial(spark, d):
    items = load(spark, d, "lineitem").select(*ITEM_KEYS, *NUM4)
    return round_doubles(rowfeat.polynomial(items, NUM4).drop(*NUM4), 4)


@query("basic_and_interaction_features", """WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events), v AS (
SELECT *, [event_id::DOUBLE, user_id::DOUBLE, value] AS x FROM e)
SELECT event_id, user_id, value, event_type, round(list_avg(x), 6) AS numeric_mean, round(list_stddev_samp(x), 6) AS numeric_std, round(list_sum(x), 6) AS numeric_sum,
  list_min(x) AS numeric_min, list_max(x) AS numeric_max, round(list_max(x) - list_min(x), 6) AS numeric_range,
  (event_type IS NULL)::INTEGER AS missing_count, round((event_type IS NULL)::INTEGER / 4.0::DOUBLE, 6) AS missing_ratio,
  (event_id * user_id)::DOUBLE AS event_id_times_user_id, round(event_id / (CASE WHEN user_id = 0 THEN 1 ELSE user_id END)::DOUBLE, 6) AS event_id_div_user_id,
  (event_id + user_id)::DOUBLE AS event_id_plus_user_id, (event_id - user_id)::DOUBLE + 0.0 AS event_id_minus_user_id FROM v""")
def basic_and_interaction_features(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return round_doubles(rowfeat.interaction_features(rowfeat.basic_features(e), ["event_id", "user_id"]))


# ---- text ------------------------------------------------------------------------------------------

def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, {_quoted(pattern)}))::BIGINT"


_WORDS = _n(f"[^{text.SPACE_CLASS}]+")


@query("text_basic", f"""SELECT doc_id, length(text)::BIGINT AS text_length, {_WORDS} AS text_word_count,
  regexp_matches(text, '\\p{{Lu}}') AS text_has_uppercase, regexp_matches(text, '\\p{{Nd}}') AS text_has_digits FROM documents""")
def text_basic(spark, d):
    return text.text_basic(spread(load(spark, d, "documents").select("doc_id", "text")), ["text"]).drop("text")


@query("text_counts", f"""SELECT doc_id, length(text)::BIGINT AS text_char_count, {_WORDS} AS text_word_count,
  round(length(text) / greatest({_WORDS}, 1)::DOUBLE, 6) AS text_avg_word_length, {_n(chr(92) + 'p{Nd}')} AS text_digit_count,
  {_n(chr(92) + 'p{Lu}')} AS text_uppercase_count, {_n(chr(92) + 'p{Ll}')} AS text_lowercase_count,
  {_n('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + text.SPACE_CLASS + ']')} AS text_special_count FROM documents""")
def text_counts(spark, d):
    return round_doubles(text.text_counts(spread(load(spark, d, "documents").select("doc_id", "text")), ["text"]).drop("text"))


_FILTERS = text.KERAS_FILTERS.replace("\t", "").replace("\n", "")
_CLEAN = f"translate(lower(text), {_quoted(_FILTERS)} || chr(9) || chr(10), repeat(' ', {len(text.KERAS_FILTERS)}))"
_TOKENS = f"list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')"
_VOCAB = f"""t AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), u AS (SELECT unnest(ws) AS word FROM t),
v AS (SELECT word, count(*)::BIGINT AS n FROM u GROUP BY 1 ORDER BY n DESC, word LIMIT 999),
voc AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word)::INTEGER AS idx FROM v)"""


@query("text_vocab", f"WITH {_VOCAB} SELECT word, n, idx FROM voc")
def text_vocab(spark, d):
    return text.text_vocab(spread(load(spark, d, "documents").select("text")), "text")


def _sequence_sql(last: str) -> str:
    return f"""WITH {_VOCAB}, k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
r AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM k JOIN voc USING (word)),
s AS (SELECT doc_id, count(*) AS n, sum(idx) AS s FROM r {last} GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::INTEGER AS text_sequence_length, coalesce(s, 0)::BIGINT AS text_sequence_sum FROM documents LEFT JOIN s USING (doc_id)"""


@query("text_sequence", _sequence_sql(""))
def text_sequence(spark, d):
    return text.text_sequence(spread(load(spark, d, "documents").select("doc_id", "text")), "text").drop("text")


@query("text_sequence_last", _sequence_sql("WHERE back <= 100"))
def text_sequence_last(spark, d):
    """The last hundred known tokens, asked for."""
    return text.text_sequence(spread(load(spark, d, "documents").select("doc_id", "text")), "text", max_length=100).drop("text")


_WORD = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_TFIDF_W = ", ".join(f"coalesce(sum(w) FILTER (i = {i}), 0) AS w{i}" for i in range(10))
_TFIDF_N = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in range(10)) + ")"


@query("text_tfidf", f"""WITH t AS (SELECT doc_id, {_WORD} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w FROM t),
best AS (SELECT w FROM u GROUP BY 1 ORDER BY count(*) DESC, w LIMIT 10), top AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i FROM best),
tf AS (SELECT doc_id, i, count(*) AS tf FROM u JOIN top USING (w) GROUP BY 1, 2),
idf AS (SELECT i, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY i),
k AS (SELECT doc_id, i, tf * idf AS w FROM tf JOIN idf USING (i)),
x AS (SELECT doc_id, {_TFIDF_W} FROM t LEFT JOIN k USING (doc_id) GROUP BY 1), n AS (SELECT *, {_TFIDF_N} AS norm FROM x)
SELECT doc_id, {', '.join(f'round(CASE WHEN norm > 0 THEN w{i} / norm ELSE 0 END, 6) AS text_tfidf_{i}' for i in range(10))} FROM n""")
def text_tfidf(spark, d):
    c = spread(load(spark, d, "documents").select("doc_id", "text"))
    return round_doubles(text.text_tfidf(c, "text").drop("text"))


_LEX = f"""t AS (SELECT doc_id, {_WORD} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word FROM t),
c AS (SELECT doc_id, word, count(*) AS c FROM u GROUP BY 1, 2),
lex AS (SELECT word, avg(2 * quality - 1) AS p, avg(toxic) AS s FROM c JOIN labels USING (doc_id) GROUP BY 1)"""


#: labels, three numbers each, that are broadcast
LABELS_SENT = 500_000


def label_lexicon(spark, d, docs):
    """Mean label of the documents holding a word, and their number. The texts stay where they are if the labels are few enough to be broadcast."""
    labels = load(spark, d, "labels").select("doc_id", "quality", "toxic")
    labels = F.broadcast(labels) if labels.count() <= LABELS_SENT else labels
    labelled = docs.join(labels, "doc_id")
    return labelled.select("quality", "toxic", F.explode(F.array_distinct(text.word_tokens("text"))).alias("word")).groupBy("word").agg(
        F.avg(2 * F.col("quality") - 1).alias("polarity"), F.avg("toxic").alias("subjectivity"), F.count("*").alias("documents"),
    )


@query("text_sentiment", f"""WITH {_LEX}, s AS (SELECT doc_id, sum(p * c) / sum(c) AS p, sum(s * c) / sum(c) AS s FROM c JOIN lex USING (word) GROUP BY 1)
SELECT doc_id, round(coalesce(p, 0), 6) + 0.0 AS text_sentiment, round(coalesce(s, 0), 6) + 0.0 AS text_subjectivity FROM documents LEFT JOIN s USING (doc_id)""")
def text_sentiment(spark, d):
    """The lexicon comes from the labelled documents: mean label of the documents holding a word."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return round_doubles(text.text_sentiment(docs, "text", "doc_id", label_lexicon(spark, d, docs), negations=(), strengths={}, weight="documents").drop("text"))


_TURNING, _STRONG = ("the", "la", "zu"), {"of": 1.5, "de": 0.5, "er": 2.0, "to": 0.8}


@query("text_sentiment_carried", f"""WITH t AS (SELECT doc_id, {_WORD} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t),
lex AS (SELECT word, avg(2 * quality - 1) AS p, avg(toxic) AS s FROM (SELECT DISTINCT doc_id, word FROM u) JOIN labels USING (doc_id) GROUP BY 1),
m AS (SELECT *, word IN {_TURNING} AS turns, CASE word {' '.join(f"WHEN '{w}' THEN {f}" for w, f in _STRONG.items())} END AS f FROM u),
a AS (SELECT *, turns OR f IS NOT NULL AS acts, sum(turns::INT) OVER w AS nt, sum(ln(coalesce(f, 1))) OVER w AS lf FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
r AS (SELECT doc_id, word, acts, nt - coalesce(last_value(CASE WHEN NOT acts THEN nt END IGNORE NULLS) OVER b, 0) AS turned,
  exp(lf - coalesce(last_value(CASE WHEN NOT acts THEN lf END IGNORE NULLS) OVER b, 0)) AS f FROM a WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT doc_id, CASE WHEN turned > 0 THEN -0.5 / f ELSE f END AS fp, CASE WHEN turned > 0 THEN 1 / f ELSE f END AS fs, p, s FROM r JOIN lex USING (word) WHERE NOT acts),
y AS (SELECT doc_id, avg(CASE WHEN abs(fp - 1) < 1e-9 THEN p ELSE greatest(-1, least(1, p * fp)) END) AS p, avg(CASE WHEN abs(fs - 1) < 1e-9 THEN s ELSE greatest(0, least(1, s * fs)) END) AS s FROM x GROUP BY 1)
SELECT doc_id, round(coalesce(p, 0), 6) + 0.0 AS text_sentiment, round(coalesce(s, 0), 6) + 0.0 AS text_subjectivity FROM documents LEFT JOIN y USING (doc_id)""")
def text_sentiment_carried(spark, d):
    """Frequent words of the invented texts stand in for negations and strength words."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return round_doubles(text.text_sentiment(docs, "text", "doc_id", label_lexicon(spark, d, docs), negations=_TURNING, strengths=_STRONG, weight="documents").drop("text"))


# ---- dates -----------------------------------------------------------------------------------------

def _parts_sql(c: str, full: bool) -> str:
    out = [
        f"year({c})::INTEGER AS {c}_year", f"month({c})::INTEGER AS {c}_month", f"day({c})::INTEGER AS {c}_day", f"hour({c})::INTEGER AS {c}_hour",
        f"(isodow({c}) - 1)::INTEGER AS {c}_dayofweek", f"isodow({c}) >= 6 AS {c}_is_weekend", f"quarter({c})::INTEGER AS {c}_quarter",
    ]
    if full:
        out += [
            f"minute({c})::INTEGER AS {c}_minute", f"second({c})::INTEGER AS {c}_second", f"dayofyear({c})::INTEGER AS {c}_dayofyear",
            f"day({c}) = 1 AS {c}_is_month_start", f"{c}::DATE = last_day({c}) AS {c}_is_month_end",
        ]
    return ", ".join(out)


@query("datetime_parts", f"SELECT o_orderkey, {_parts_sql('o_orderdate', False)} FROM orders")
def datetime_parts(spark, d):
    return temporal.datetime_parts(load(spark, d, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query("datetime_parts_full", f"SELECT event_id, {_parts_sql('ts', True)} FROM events")
def datetime_parts_full(spark, d):
    return temporal.datetime_parts_full(load(spark, d, "events").select("event_id", "ts")).drop("ts")


@query("to_datetime_coerce", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS placed FROM orders""")
def to_datetime_coerce(spark, d):
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n/a "), "o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    out = temporal.to_datetime_coerce(load(spark, d, "orders").select("o_orderkey", t.alias("placed")), ["placed"])
    return out.withColumn("placed", F.col("placed").cast("timestamp_ntz"))


_DATE_TEXTS = """t AS (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y') AS eu, strftime(o_orderdate, '%b %-d, %Y') AS named,
  strftime(o_orderdate, '%Y%m%d') AS compact, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'n/a' END AS mixed FROM orders)"""


def date_texts(orders):
    """Order dates as texts of five kinds; the last one mixes formats and holds cells that are no dates."""
    f = lambda p: F.date_format("o_orderdate", p)
    mixed = F.when(F.col("o_orderkey") % 3 == 0, f("yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, f("dd.MM.yyyy")).otherwise("n/a")
    return orders.select("o_orderkey", f("MM/dd/yyyy").alias("us"), f("dd/MM/yyyy").alias("eu"), f("MMM d, yyyy").alias("named"), f("yyyyMMdd").alias("compact"), mixed.alias("mixed"))


def _either(c: str, first: str, second: str) -> str:
    """The first format if it parses the whole column, else the second."""
    return f"CASE WHEN (SELECT bool_and(try_strptime({c}, '{first}') IS NOT NULL) FROM t) THEN try_strptime({c}, '{first}') ELSE try_strptime({c}, '{second}') END AS {c}"


@query("to_datetime_formats", f"""WITH {_DATE_TEXTS}
SELECT o_orderkey, {_either('us', '%m/%d/%Y', '%d/%m/%Y')}, {_either('eu', '%m/%d/%Y', '%d/%m/%Y')}, try_strptime(named, '%b %d, %Y') AS named, try_strptime(compact, '%Y%m%d') AS compact,
  coalesce(try_strptime(mixed, '%Y-%m-%d'), CASE WHEN (SELECT count(try_strptime(mixed, '%d.%m.%Y')) >= count(try_strptime(mixed, '%m.%d.%Y')) FROM t)
    THEN try_strptime(mixed, '%d.%m.%Y') ELSE try_strptime(mixed, '%m.%d.%Y') END) AS mixed FROM t""")
def to_datetime_formats(spark, d):
    """Formats are found from the columns: day or month first, month names, digits only, several in one column."""
    cols = ["us", "eu", "named", "compact", "mixed"]
    out = temporal.to_datetime_coerce(date_texts(load(spark, d, "orders")), cols)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


# ---- selection -------------------------------------------------------------------------------------

_ANOVA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


def _anova(table: str, target: str, cols: list[str], key: str = "feature") -> str:
    return union_all([
        f"""SELECT '{c}' AS {key}, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (
SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {table}) AS gm FROM {table} GROUP BY {target})""" for c in cols
    ])


@query("f_classif", f"SELECT feature, round(score, 6) AS score FROM ({_anova('lineitem', 'l_returnflag', _ANOVA_COLS)})")
def f_classif(spark, d):
    return round_doubles(select.f_classif(load(spark, d, "lineitem"), "l_returnflag", _ANOVA_COLS))


@query("f_regression", union_all([
    f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 5) AS score FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax", "l_suppkey"]
]))
def f_regression(spark, d):
    return round_doubles(select.f_regression(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_suppkey"]), 5)


_DIMS = list(range(64))
_WIDE = "wide AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in _DIMS) + " FROM embeddings)"


def _wide(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in _DIMS])


@query("select_k_best", f"""WITH {_WIDE}, s AS ({_anova('wide', 'label', [f'x{i}' for i in _DIMS])}), k AS (
SELECT feature FROM s ORDER BY score DESC, substr(feature, 2)::INTEGER DESC LIMIT 20), tall AS (
UNPIVOT wide ON {', '.join(f'x{i}' for i in _DIMS)} INTO NAME feature VALUE v)
SELECT vec_id, label, feature, v FROM tall JOIN k USING (feature)""")
def select_k_best(spark, d):
    """The kept columns as rows, so that the result names them."""
    out = select.select_k_best(_wide(spark, d), "label", 20, exclude=["vec_id"])
    kept = [c for c in out.columns if c.startswith("x")]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept]))
    return out.select("vec_id", "label", cells.alias("r")).select("vec_id", "label", "r.*")


@query("variance_threshold", f"""SELECT {_K}, l_quantity, l_extendedprice FROM lineitem
WHERE (SELECT var_pop(l_quantity) > 0.01 AND var_pop(l_extendedprice) > 0.01 AND var_pop(l_discount) <= 0.01 AND var_pop(l_tax) <= 0.01 FROM lineitem)""")
def variance_threshold(spark, d):
    return select.variance_threshold(load(spark, d, "lineitem").select(*ITEM_KEYS, *NUM4), 0.01, exclude=ITEM_KEYS)


# ---- projections, clusters, importances ------------------------------------------------------------

@query("zero_fraction", """WITH z AS (SELECT (count(*) * 3)::BIGINT AS cells, sum((l_discount = 0)::BIGINT + (l_tax = 0)::BIGINT + (l_quantity = 0)::BIGINT)::BIGINT AS zeros FROM lineitem)
SELECT cells, zeros, round(zeros / cells::DOUBLE, 6) AS fraction, CASE WHEN zeros / cells::DOUBLE > 0.5 THEN 'SVD' ELSE 'PCA' END AS method FROM z""")
def zero_fraction(spark, d):
    return round_doubles(reduce.zero_fraction(load(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"]))


_TWO = "SELECT l_quantity AS x, l_extendedprice / 4000 AS y FROM lineitem"


@query("reduce_pca", f"""WITH t AS ({_TWO}), c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM t),
l AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM c)
SELECT 'PCA_1' AS component, round(l1, 6) AS variance, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS cross_corr FROM l
UNION ALL SELECT 'PCA_2', round(l2, 6), 0.0, 0.0 FROM l""")
def reduce_pca(spark, d):
    """Variance of each component against the closed form for two columns; components are centred and uncorrelated."""
    t = load(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 4000).alias("y"))
    p = reduce.reduce_pca(t, 2)
    row = p.agg(
        F.var_samp("PCA_1").alias("v1"), F.var_samp("PCA_2").alias("v2"), F.avg("PCA_1").alias("m1"), F.avg("PCA_2").alias("m2"), F.corr("PCA_1", "PCA_2").alias("cc"),
    )
    rows = F.array(*[F.struct(F.lit(f"PCA_{i}").alias("component"), F.col(f"v{i}").alias("variance"), F.col(f"m{i}").alias("mean"), F.col("cc").alias("cross_corr")) for i in (1, 2)])
    return round_doubles(row.select(F.explode(rows).alias("r")).select("r.*"))


@query("reduce_pca_embeddings", f"""WITH {_WIDE}
SELECT count(*)::BIGINT AS n_rows, round({' + '.join(f'var_samp(x{i})' for i in _DIMS)}, 6) AS total_variance, 0.0::DOUBLE AS mean FROM wide""")
def reduce_pca_embeddings(spark, d):
    """All 64 components keep the total variance and are centred."""
    p = reduce.reduce_pca(_wide(spark, d), 64, exclude=["vec_id", "label"])
    names = [f"PCA_{i + 1}" for i in _DIMS]
    variance, mean = F.lit(0.0), F.lit(0.0)
    for n in names:
        variance, mean = variance + F.var_samp(n), mean + F.abs(F.avg(n))
    return round_doubles(p.agg(F.count("*").alias("n_rows"), variance.alias("total_variance"), mean.alias("mean")))


@query("reduce_svd", f"""WITH t AS ({_TWO}), c AS (SELECT sum(x * x) / count(*) AS a, sum(x * y) / count(*) AS b, sum(y * y) / count(*) AS c FROM t)
SELECT 'SVD_1' AS component, round((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b), 5) AS mean_square FROM c
UNION ALL SELECT 'SVD_2', round((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 5) FROM c""")
def reduce_svd(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 4000).alias("y"))
    p = reduce.reduce_svd(t, 2)
    row = p.agg(F.avg(F.col("SVD_1") ** 2).alias("s1"), F.avg(F.col("SVD_2") ** 2).alias("s2"))
    rows = F.array(*[F.struct(F.lit(f"SVD_{i}").alias("component"), F.col(f"s{i}").alias("mean_square")) for i in (1, 2)])
    return round_doubles(row.select(F.explode(rows).alias("r")).select("r.*"), 5)


@query("cluster_features", union_all([f"SELECT {k} AS k, count(*)::BIGINT AS n_rows, {k}::BIGINT AS labels, 0::BIGINT AS bad_distances FROM lineitem" for k in (2, 3, 5)]))
def cluster_features(spark, d):
    """Rows, labels used, and rows without a valid distance, per k; labels and distances are held against brute force in the tests."""
    out = reduce.cluster_features(load(spark, d, "lineitem").select(*NUM4), NUM4)
    tall = out.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"cluster_k{k}").alias("label"), F.col(f"cluster_k{k}_dist").alias("dist")) for k in (2, 3, 5)
    ])).alias("r")).select("r.*")
    return tall.groupBy("k").agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("labels"), F.count_if(~(F.col("dist") >= 0)).alias("bad_distances"))


CLUSTER_STARTS = [[0.731, 0.617, 2.411], [2.513, 3.907, 0.389], [4.219, 5.803, 1.759]]
CLUSTER_ROUNDS = 6


def _lloyd_sql() -> str:
    """Rounds of k-means from the given starts, one row of centres per round."""
    near = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    off = ", ".join(f"(a - a{i}) * (a - a{i}) + (b - b{i}) * (b - b{i}) + (c - c{i}) * (c - c{i}) AS d{i}" for i in range(3))
    rounds = "r0 AS (SELECT " + ", ".join(f"{v}::DOUBLE AS {n}{i}" for i, row in enumerate(CLUSTER_STARTS) for n, v in zip("abc", row)) + ")"
    for r in range(CLUSTER_ROUNDS + 1):
        rounds += f", l{r} AS (SELECT a, b, c, {near} AS label, least(d0, d1, d2) AS d FROM (SELECT a, b, c, {off} FROM p, r{r}))"
        rounds += f", r{r + 1} AS (SELECT " + ", ".join(f"avg({n}) FILTER (label = {i}) AS {n}{i}" for i in range(3) for n in "abc") + f" FROM l{r})"
    centers = union_all([f"SELECT {i} AS label, a{i} AS a, b{i} AS b, c{i} AS c FROM r{CLUSTER_ROUNDS}" for i in range(3)])
    return f"""WITH p AS (SELECT l_quantity / 10.0::DOUBLE AS a, l_extendedprice / 10000.0::DOUBLE AS b, l_discount * 30.0::DOUBLE AS c FROM lineitem), {rounds},
m AS ({centers}), n AS (SELECT label, count(*) AS n, sum(d) AS inertia FROM l{CLUSTER_ROUNDS} GROUP BY 1)
SELECT (row_number() OVER (ORDER BY a, b, c) - 1)::INTEGER AS label, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, n::BIGINT AS n, round(inertia, 3) AS inertia FROM m JOIN n USING (label)"""


@query("cluster_given_starts", _lloyd_sql())
def cluster_given_starts(spark, d):
    """Centres, sizes and squared distances after six rounds from given starts."""
    x = load(spark, d, "lineitem").select(
        (F.col("l_quantity") / 10.0).alias("a"), (F.col("l_extendedprice") / 10000.0).alias("b"), (F.col("l_discount") * 30.0).alias("c"))
    centers = reduce.fit_clusters(x, ["a", "b", "c"], [3], rounds=CLUSTER_ROUNDS, first=CLUSTER_STARTS)[3]
    off = F.array(*[sum((F.col(n) - v) * (F.col(n) - v) for n, v in zip("abc", m)) for m in centers])
    near = x.select(off.alias("off")).select((F.array_position("off", F.array_min("off")) - 1).cast("int").alias("label"), F.array_min("off").alias("d"))
    sizes = near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("d"), 3).alias("inertia"))
    at = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in centers]), F.col("label") + 1)
    return sizes.select("label", *[F.round(at(i), 6).alias(n) for i, n in enumerate("abc")], "n", "inertia")


@query("rf_importance_leader", "SELECT 'l_extendedprice' AS feature, true AS leads FROM lineitem LIMIT 1")
def rf_importance_leader(spark, d):
    """One column decides the target: its share leads by far."""
    item = load(spark, d, "lineitem").select(*NUM4, (F.col("l_extendedprice") > 30000).cast("int").alias("y"))
    imp = reduce.rf_importance(item, "y", trees=10, depth=5)
    return imp.orderBy(F.desc("importance")).limit(1).select("feature", (F.col("importance") > 0.7).alias("leads"))


@query("rf_importance", "SELECT count(*)::BIGINT AS features, 1.0::DOUBLE AS total, true AS non_negative FROM (VALUES (1), (2), (3), (4), (5)) WHERE (SELECT count(*) FROM part) > 0")
def rf_importance(spark, d):
    p = load(spark, d, "part").select("p_name", "p_brand", "p_type", "p_size", "p_partkey", "p_retailprice")
    imp = reduce.rf_importance(p, "p_retailprice", trees=20, depth=5)
    return round_doubles(imp.agg(F.count("*").alias("features"), F.sum("importance").alias("total"), F.bool_and(F.col("importance") >= 0).alias("non_negative")))


@query("cumulative_importance", """WITH i AS (SELECT props AS feature, sum(value) / (SELECT sum(value) FROM events) AS importance FROM events GROUP BY 1),
c AS (SELECT row_number() OVER w AS rank, feature, importance, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative
  FROM i WINDOW w AS (ORDER BY importance DESC, feature))
SELECT rank::INTEGER AS rank, feature, round(importance, 6) AS importance, round(cumulative, 6) AS cumulative,
  coalesce(lag(cumulative) OVER (ORDER BY rank) <= 0.8, true) AS needed FROM c""")
def cumulative_importance(spark, d):
    e = load(spark, d, "events")
    whole = e.agg(F.sum("value")).first()[0]
    shares = e.groupBy(F.col("props").alias("feature")).agg((F.sum("value") / F.lit(whole)).alias("importance"))
    return round_doubles(reduce.cumulative_importance(shares))


# ---- vectors ---------------------------------------------------------------------------------------

_STATUS = ["O", "P"]
_PRIORITY = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("vectorize", f"""WITH s AS (SELECT avg(o_custkey) AS m1, stddev_pop(o_custkey) AS s1, avg(o_totalprice) AS m2, stddev_pop(o_totalprice) AS s2 FROM orders)
SELECT o_orderkey, 8 AS dimension, round((o_custkey - m1) / s1, 6) + 0.0 AS f0, round((o_totalprice - m2) / s2, 6) + 0.0 AS f1,
  {', '.join(f"(o_orderstatus = '{v}')::INTEGER::DOUBLE AS f{i + 2}" for i, v in enumerate(_STATUS))},
  {', '.join(f"(o_orderpriority = '{v}')::INTEGER::DOUBLE AS f{i + 4}" for i, v in enumerate(_PRIORITY))} FROM orders, s""")
def vectorize(spark, d):
    o = load(spark, d, "orders").drop("o_orderdate")
    v = vector.vectorize(o, exclude=["o_orderkey"], as_array=True)
    return round_doubles(v.select("o_orderkey", F.size("features").alias("dimension"), *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(8)]))


@query("vectorize_sparse", """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, 'c' || o_custkey AS cust FROM orders), n AS (SELECT count(DISTINCT cust) AS n, count(DISTINCT o_orderstatus) AS m FROM o),
s AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM o),
st AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS k FROM (SELECT DISTINCT o_orderstatus FROM o)), cu AS (SELECT cust, row_number() OVER (ORDER BY cust) - 1 AS k FROM (SELECT DISTINCT cust FROM o))
SELECT o_orderkey, (1 + m - 1 + n - 1)::BIGINT AS size, 0::BIGINT AS index, round((o_totalprice - mu) / sd, 6) + 0.0 AS value FROM o, s, n WHERE o_totalprice <> mu
UNION ALL SELECT o_orderkey, (m + n - 1)::BIGINT, k::BIGINT, 1.0 FROM o JOIN st USING (o_orderstatus), n WHERE k > 0
UNION ALL SELECT o_orderkey, (m + n - 1)::BIGINT, (m + k - 1)::BIGINT, 1.0 FROM o JOIN cu USING (cust), n WHERE k > 0""")
def vectorize_sparse(spark, d):
    """As (row, index, value); one column has thousands of values, which are ranked and looked up by shuffle."""
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.concat(F.lit("c"), "o_custkey").alias("cust"))
    v = vector.vectorize_sparse(o, exclude=["o_orderkey"], max_rows=100)
    return round_doubles(v.select("o_orderkey", "size", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("o_orderkey", "size", F.col("x.indices").alias("index"), F.col("x.values").alias("value")))
