"""URL verdicts from rules and a path-template tree.

Rules come first (the longest that fits wins). Every other address is judged by its template: per host, the tree of path
segments is grown level by level; a segment stays literal where it holds a share of its branch, else it is a wildcard.
Sibling templates that differ in one literal are merged where their labelled rates do not differ statistically. A
template is rejected by its smoothed purity: blocked labels over all its addresses, each unlabelled address and a constant
weighing in with the prior. Labels are the rule verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import load, query, ref
from prepspark.session import materialize

# (verdict, host and path prefix) as the task fixes them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DEPTH = 4
SHARE = 20
SUPPORT = 5
Z = 1.96
PRIOR, WEIGHT, REJECT = 0.5, 2.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null if none does. The rules are the caller's list, not data."""
    name = verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def grow(paths: DataFrame, depth: int = DEPTH, share: int = SHARE, support: int = SUPPORT) -> DataFrame:
    """Add ``template`` to distinct (host, path, n, ...) rows; segments beyond ``depth`` share one tail wildcard.

    A segment is literal if at least ``support`` addresses and one in ``share`` of its branch carry it, so a branch has at
    most ``share`` literal children whatever the size of the host.
    """
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substr(path, 2)"), "/", -1))
    tree = paths.withColumns({"segs": segs, "template": F.lit("")})
    for d in range(depth):
        tree = materialize(tree.withColumn("seg", F.expr(f"get(segs, {d})")), "url-tree")
        children = tree.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("c"))
        totals = children.groupBy("host", "template").agg(F.sum("c").alias("total"))
        literal = children.join(totals, ["host", "template"]).where(f"c >= {support} AND c * {share} >= total")
        literal = literal.select("host", "template", "seg", F.lit(True).alias("literal"))
        step = F.when(F.col("seg").isNull(), "").when(F.col("literal"), F.concat(F.lit("/"), F.col("seg"))).otherwise("/*")
        tree = tree.join(literal, ["host", "template", "seg"], "left").withColumn("template", F.concat("template", step)).drop("literal", "seg")
    return tree.withColumn("template", F.when(F.size("segs") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segs")


def merge(templates: DataFrame, z: float = Z) -> DataFrame:
    """Add ``branch`` to (host, template, n, k, b) rows: the shape that similar siblings share, else the template itself.

    A shape is the template with its first literal replaced. Siblings are similar if their blocked rate lies within ``z``
    standard errors of the shape's; templates without labels give no evidence and stay apart.
    """
    rows = templates.withColumn("shape", F.regexp_replace("template", r"^((?:/\*)*)/[^/*][^/]*", "$1/~"))
    pool = rows.groupBy("host", "shape").agg(F.sum("k").alias("pk"), F.sum("b").alias("pb"))
    p = F.col("pb") / F.nullif("pk", F.lit(0))
    near = (F.col("k") > 0) & ((F.col("b") - F.col("k") * p) * (F.col("b") - F.col("k") * p) <= z * z * F.col("k") * p * (1 - p))
    return rows.join(pool, ["host", "shape"]).withColumn("branch", F.when(near, F.col("shape")).otherwise(F.col("template"))).drop("shape", "pk", "pb")


def judge(df: DataFrame, keep: list[str], url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Columns ``keep`` plus host, path, rule, template, purity and verdict of every row.

    A null address, or one without ``://``, has empty host and path and is judged like any other; equal rows stay. An empty
    table gives an empty result. Purity lies between 0 and 1 and is that of the merged branch.
    """
    host, path = host_and_path(ref(url))
    rows = df.select(F.struct(*[ref(c) for c in keep]).alias("__keep"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("said").alias("k"), F.count(F.when(F.col("said") == "block", 1)).alias("b"))
    tree = materialize(grow(paths), "url-templates")
    templates = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "k", "b")])
    branches = merge(templates)
    pooled = branches.groupBy("host", "branch").agg(*[F.sum(c).alias(c) for c in ("n", "k", "b")])
    purity = (F.col("b") + PRIOR * (WEIGHT + F.col("n") - F.col("k"))) / (F.col("n") + WEIGHT)
    scored = branches.select("host", "template", "branch").join(pooled.select("host", "branch", F.round(purity, 6).alias("purity")), ["host", "branch"])
    known = tree.select("host", "path", "template").join(scored.select("host", "template", "purity"), ["host", "template"])
    method = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return rows.join(known, ["host", "path"], "left").select(
        *[F.col("__keep").getField(c).alias(c) for c in keep], "host", "path", "rule", "template", "purity",
        F.coalesce("said", method).alias("verdict"))


def _sql() -> str:
    fits = {r: f"(host = '{r.split('/')[0]}' OR suffix(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')" for _, r in RULES}
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for _, r in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{a}'" for a, r in longest) + " END"
    levels = ""
    for d in range(DEPTH):
        levels += f""",
c{d} AS (SELECT host, template, segs[{d + 1}] AS seg, sum(n) AS c FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
l{d} AS (SELECT host, template, seg, c, sum(c) OVER (PARTITION BY host, template) AS total FROM c{d}),
t{d + 1} AS (SELECT t.* EXCLUDE (template), t.template || CASE WHEN len(segs) <= {d} THEN ''
  WHEN c >= {SUPPORT} AND c * {SHARE} >= total THEN '/' || segs[{d + 1}] ELSE '/*' END AS template
  FROM t{d} t LEFT JOIN l{d} l ON t.host = l.host AND t.template = l.template AND segs[{d + 1}] = l.seg)"""
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {said} AS said FROM u),
t0 AS (SELECT host, path, count(*) AS n, count(said) AS k, count(*) FILTER (said = 'block') AS b,
  CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(path[2:], '/') END AS segs, '' AS template FROM r GROUP BY host, path){levels},
f AS (SELECT * REPLACE (CASE WHEN len(segs) > {DEPTH} THEN template || '/**' ELSE template END AS template) FROM t{DEPTH}),
g AS (SELECT host, template, sum(n) AS n, sum(k) AS k, sum(b) AS b,
  regexp_replace(template, '^((?:/\\*)*)/[^/*][^/]*', '\\1/~') AS shape FROM f GROUP BY host, template),
p AS (SELECT *, sum(k) OVER w AS pk, sum(b) OVER w AS pb FROM g WINDOW w AS (PARTITION BY host, shape)),
q AS (SELECT *, CASE WHEN k > 0 AND (b - k * (pb / nullif(pk, 0))) * (b - k * (pb / nullif(pk, 0))) <= {Z * Z} * k * (pb / nullif(pk, 0)) * (1 - pb / nullif(pk, 0)) THEN shape ELSE template END AS branch FROM p),
s AS (SELECT host, template, round((sum(b) OVER w + {PRIOR} * ({WEIGHT} + sum(n) OVER w - sum(k) OVER w)) / (sum(n) OVER w + {WEIGHT}), 6)::DOUBLE AS purity
  FROM q WINDOW w AS (PARTITION BY host, branch))
SELECT page_id, host, path, rule, template, purity, coalesce(said, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN f USING (host, path) JOIN s USING (host, template)
"""


@query("op10_url_filters", _sql())
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), ["page_id"])
