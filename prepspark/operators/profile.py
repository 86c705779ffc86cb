"""Profiles and role detection: one row per column, rules over that small table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import (
    col, columns_of, datetime_columns, is_missing, kinds, num, numeric_columns, one_row, stack_rows, string_columns, total,
)
from prepspark.functions.dates import find_formats
from prepspark.functions.stats import SKETCH_ERROR, decided_distinct_counts, distinct_counts, skew_expr

# Target names as matched in lower case, in this order of mention.
TARGET_NAMES = (
    "target", "label", "class", "outcome", "response", "survived", "y", "dependent", "result", "diagnosis",
    "churn", "fraud", "click", "conversion", "default", "price", "salary", "income", "value", "score",
)
#: the report variant knows only the classification names
REPORT_TARGET_NAMES = TARGET_NAMES[:15]
# Name parts that mark an identifier, and name parts that mark a text.
ID_NAMES = ("id", "index", "key", "uuid", "guid")
TEXT_HINTS = ("text", "desc", "review", "comment")


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: str
    kind: str
    rows: int
    missing: int
    distinct: int
    mean_length: float | None


# ---- profile table --------------------------------------------------------------------------------

def profile_missing(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct), one aggregation for all columns."""
    def pct(c: str) -> Column:
        return F.when(F.count("*") > 0, F.count_if(is_missing(df, c)) * 100.0 / F.count("*"))

    return stack_rows(df, {c: {"missing": F.count_if(is_missing(df, c)), "missing_pct": pct(c)} for c in df.columns})


def profile_distinct(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, dtype, distinct_values) of the non-nested columns."""
    names = [c for c, k in kinds(df).items() if k != "nested"]
    counts = decided_distinct_counts(df, cols=names) if exact else distinct_counts(df, names, exact=False)
    types = dict(df.dtypes)
    return _table(df, [(c, types[c], counts[c]) for c in names], "column string, dtype string, distinct_values long")


def profile_overview(df: DataFrame) -> DataFrame:
    """(item, value): rows, columns, cells, missing cells, bytes, and columns per type."""
    fixed = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4}
    widths, exprs = 0, {}
    for name, dtype in df.dtypes:
        if dtype == "string":
            exprs[name] = F.sum(F.octet_length(col(name)))
        else:
            widths += fixed.get(dtype, 8)
    string_bytes = total([F.coalesce(e, F.lit(0)) for e in exprs.values()])
    missing = F.sum(total([is_missing(df, c).cast("long") for c in df.columns]))
    row = df.agg(
        F.count("*").alias("rows"), F.coalesce(missing, F.lit(0)).alias("missing"),
        (string_bytes + F.count("*") * widths).alias("bytes"),
    )
    per_type: dict[str, int] = {}
    for _, dtype in df.dtypes:
        per_type[dtype] = per_type.get(dtype, 0) + 1
    n_cols = len(df.columns)
    items = [
        ("rows", F.col("rows")), ("columns", F.lit(n_cols)), ("cells", F.col("rows") * n_cols),
        ("missing_cells", F.col("missing")), ("bytes", F.col("bytes")),
        *[(f"dtype:{t}", F.lit(k)) for t, k in sorted(per_type.items())],
    ]
    structs = [F.struct(F.lit(i).alias("item"), v.cast("long").alias("value")) for i, v in items]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def collect_profile(df: DataFrame, exact: bool = False, unique: bool = False) -> list[ColumnProfile]:
    """The profile as driver rows (one per column): up to three jobs in all.

    Unless ``exact``, distinct counts are exact only where a rule could turn on
    them: below 200, near a share of the rows for text columns and the last
    column, and near the row count for every column if ``unique``.
    """
    ks = kinds(df)
    flat = [c for c in df.columns if ks[c] != "nested"]
    exprs: dict = {"n": F.count("*")}
    for c in df.columns:
        exprs[("missing", c)] = F.count_if(is_missing(df, c))
        if ks[c] == "string":
            exprs[("len", c)] = F.avg(F.length(col(c)))
    for c in flat:
        exprs[("nd", c)] = F.approx_count_distinct(col(c), SKETCH_ERROR)
    got = one_row(df, exprs)
    n = got["n"]
    shares = [0.1 * n, 0.5 * n, n]
    marks = {c: shares if ks[c] == "string" or c == df.columns[-1] else [n] if unique else [] for c in flat}
    estimates = {c: got[("nd", c)] for c in flat}
    nd = decided_distinct_counts(df, None if exact else marks, flat, estimates)
    types = dict(df.dtypes)
    return [
        ColumnProfile(c, types[c], ks[c], n, got[("missing", c)], nd.get(c, 0), got.get(("len", c))) for c in df.columns
    ]


# ---- role rules over the profile ------------------------------------------------------------------

def _tokens(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [t for t in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if t]


def is_text(p: ColumnProfile, rule: str = "c") -> bool:
    """The five text rules; ``rule`` names which one."""
    if p.kind != "string" or p.rows == 0:
        return False
    long_ = (p.mean_length or 0) > 20
    share = p.distinct / p.rows
    if rule == "a":
        return long_ and share > 0.5
    if rule == "b":
        return long_ and share > 0.1
    if rule == "c":
        return long_ and share > 0.1 and p.distinct > 10
    if rule == "d":
        return long_
    if rule == "e":
        hinted = any(h in p.name.lower() for h in TEXT_HINTS)
        return p.missing < p.rows and (share > 0.1 or long_ or hinted)
    raise ValueError(f"unknown text rule '{rule}'")


def is_id_like(p: ColumnProfile, by_substring: bool = False) -> bool:
    """Identifier by a token of its name, or a string column without repeats.

    ``by_substring`` is the looser variant: 'id', 'index' or 'key' anywhere in
    the name, or any column without repeats.
    """
    if by_substring:
        return any(k in p.name.lower() for k in ID_NAMES[:3]) or p.distinct == p.rows
    return any(t in ID_NAMES for t in _tokens(p.name)) or (p.kind == "string" and p.distinct == p.rows)


def column_roles(p: ColumnProfile, text_rule: str = "c") -> list[str]:
    roles = []
    if p.kind == "numeric":
        roles.append("numeric")
        if p.distinct == 2:
            roles.append("binary")
    elif p.kind == "string":
        roles.append("text" if is_text(p, text_rule) else "categorical")
    elif p.kind in ("datetime", "boolean"):
        roles.append(p.kind)
    if is_id_like(p):
        roles.append("id_like")
    return roles


def roles_of(profile: list[ColumnProfile], text_rule: str = "c") -> dict[str, list[str]]:
    out: dict[str, list[str]] = {
        r: [] for r in ("numeric", "categorical", "text", "datetime", "binary", "boolean", "id_like")
    }
    for p in profile:
        for r in column_roles(p, text_rule):
            out[r].append(p.name)
    return out


def target_kind(p: ColumnProfile) -> str | None:
    """'binary', 'multiclass', 'regression' or None for one column."""
    if p.distinct == 2 and not is_id_like(p):
        return "binary"
    if 3 <= p.distinct <= 20 and not is_id_like(p):
        return "multiclass"
    if p.distinct > 20 and p.kind == "numeric":
        return "regression"
    return None


def pick_target(profile: list[ColumnProfile], variant: str = "transform", user_target: str | None = None) -> str | None:
    """Target column by name, then by distinct count, then the last column.

    Variants: ``transform`` (any binary column), ``features`` (numeric binary
    columns only), ``runner`` (as features, then any column with 2 to 10
    values), ``report`` (classification names only; first column with 2, or 3 to
    20 values if string or few against the rows; honours ``user_target``).
    """
    if user_target and any(p.name == user_target for p in profile):
        return user_target
    names = REPORT_TARGET_NAMES if variant == "report" else TARGET_NAMES
    for p in profile:
        if p.name.lower() in names:
            return p.name
    for p in profile:
        if variant == "report":
            classes = 3 <= p.distinct <= 20 and (p.kind == "string" or p.distinct < 0.1 * p.rows)
            if p.distinct == 2 or classes:
                return p.name
        elif p.distinct == 2 and (variant == "transform" or p.kind in ("numeric", "boolean")):
            return p.name
    if profile:
        last = profile[-1]
        if (last.distinct <= 20) if variant == "report" else (last.distinct < 0.5 * last.rows):
            return last.name
    if variant == "runner":
        for p in profile:
            if 2 <= p.distinct <= 10:
                return p.name
    return None


# ---- the rules as tables --------------------------------------------------------------------------

def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def profile_roles(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, role): every role of every column; booleans are their own role."""
    profile = collect_profile(df, exact)
    return _table(df, [(p.name, r) for p in profile for r in column_roles(p)], "column string, role string")


def profile_runner_roles(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, role) of the runner variant: text, datetime, binary and id columns leave ``categorical``."""
    profile = collect_profile(df, exact, unique=True)
    parsed = set(datetime_strings(df, [p.name for p in profile if p.kind == "string"]))
    rows = []
    for p in profile:
        special = []
        if is_text(p, "e"):
            special.append("text")
        if p.kind == "datetime" or p.name in parsed:
            special.append("datetime")
        if p.distinct == 2:
            special.append("binary")
        if is_id_like(p, by_substring=True):
            special.append("id_like")
        if p.kind == "numeric":
            rows.append((p.name, "numeric"))
        elif p.kind == "string" and not special:
            rows.append((p.name, "categorical"))
        rows += [(p.name, r) for r in special]
    return _table(df, rows, "column string, role string")


def detect_text(df: DataFrame, rules: str = "abcde", exact: bool = False) -> DataFrame:
    """(column, rule, is_text) for every string column and rule."""
    rows = [(p.name, r, is_text(p, r)) for p in collect_profile(df, exact) if p.kind == "string" for r in rules]
    return _table(df, rows, "column string, rule string, is_text boolean")


def detect_id_like(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, by_name_or_string, by_substring)."""
    rows = [(p.name, is_id_like(p), is_id_like(p, True)) for p in collect_profile(df, exact, unique=True)]
    return _table(df, rows, "column string, id_like boolean, id_like_substring boolean")


def datetime_strings(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """String columns of which one date format parses every non-blank cell (whole column, one aggregation)."""
    formats = find_formats(df, string_columns(df) if cols is None else cols)
    return [c for c, f in formats.items() if f.whole]


def detect_datetime(df: DataFrame) -> DataFrame:
    """(column, source): typed datetime columns and string columns that parse throughout."""
    rows = [(c, "typed") for c in datetime_columns(df)] + [(c, "parsed") for c in datetime_strings(df)]
    return _table(df, rows, "column string, source string")


def detect_target(df: DataFrame, user_target: str | None = None, exact: bool = False) -> DataFrame:
    """(variant, target) for the four detection variants."""
    profile = collect_profile(df, exact)
    variants = ("transform", "features", "runner", "report")
    rows = [(v, pick_target(profile, v, user_target if v == "report" else None)) for v in variants]
    return _table(df, rows, "variant string, target string")


def target_candidates(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, target_kind) of the columns that could be a target."""
    rows = [(p.name, target_kind(p)) for p in collect_profile(df, exact) if target_kind(p)]
    return _table(df, rows, "column string, target_kind string")


def class_balance(df: DataFrame, target: str) -> tuple[int, int]:
    """(largest, smallest) class of the target, nulls left out."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target)).count()
    row = counts.agg(F.max("count"), F.min("count")).first()
    return row[0] or 0, row[1] or 0


def dataset_kind(df: DataFrame, profile: list[ColumnProfile] | None = None) -> dict:
    """Kind of table with its flags; also the text columns (rule a) and the target."""
    profile = collect_profile(df) if profile is None else profile
    text = [p.name for p in profile if is_text(p, "a")]
    kinds_present = {p.kind for p in profile}
    target = pick_target(profile, "transform")
    info = {
        "kind": "tabular", "has_text": bool(text), "has_numeric": "numeric" in kinds_present,
        "has_categorical": "string" in kinds_present, "has_datetime": "datetime" in kinds_present,
        "has_missing": any(p.missing for p in profile), "target": target, "is_imbalanced": False, "text_columns": text,
    }
    if target is not None and next(p for p in profile if p.name == target).distinct <= 10:
        largest, smallest = class_balance(df, target)
        info["is_imbalanced"] = smallest > 0 and largest / smallest > 5
    if info["has_text"] and not info["has_numeric"]:
        info["kind"] = "text"
    elif info["has_datetime"]:
        info["kind"] = "time_series"
    elif info["has_numeric"] and info["has_categorical"]:
        info["kind"] = "mixed"
    return info


def detect_dataset_kind(df: DataFrame) -> DataFrame:
    info = dataset_kind(df)
    fields = [
        "kind", "has_text", "has_numeric", "has_categorical", "has_datetime", "has_missing", "target", "is_imbalanced",
    ]
    schema = ", ".join(f"{f} {'string' if f in ('kind', 'target') else 'boolean'}" for f in fields)
    return _table(df, [tuple(info[f] for f in fields)], schema)


def top_missing(df: DataFrame, k: int = 5) -> DataFrame:
    """The k columns with most missing cells, ties by name."""
    return profile_missing(df).where("missing > 0").orderBy(F.desc("missing"), "column").limit(k)


def high_missing(df: DataFrame, threshold_pct: float = 30.0, k: int | None = None) -> DataFrame:
    """Columns (in schema order) above the missing share; the first k if asked for."""
    order = {c: i for i, c in enumerate(df.columns)}
    at = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("column"))
    found = profile_missing(df).where(F.col("missing_pct") > threshold_pct)
    found = found.orderBy(at)
    return found if k is None else found.limit(k)


def quality_score(df: DataFrame) -> DataFrame:
    """One row: completeness in percent, whole-number score and status."""
    n_cols = len(df.columns)
    row = df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(total([is_missing(df, c).cast("long") for c in df.columns])), F.lit(0)).alias("missing_values"),
    )
    cells = F.greatest(F.col("row_count") * n_cols, F.lit(1))
    completeness = (cells - F.col("missing_values")) * 100.0 / cells
    status = F.when(F.col("completeness") > 90, "excellent").when(F.col("completeness") > 75, "good").otherwise("needs_attention")
    return row.select(
        "row_count", F.lit(n_cols).alias("column_count"), "missing_values", completeness.alias("completeness"),
    ).withColumns({"quality_score": F.floor("completeness").cast("int"), "status": status})


def advise(df: DataFrame, target: str | None = None) -> DataFrame:
    """(topic, rule, value): which advice rules fire, and the numbers behind them."""
    numeric, strings = numeric_columns(df), string_columns(df)
    exprs: dict = {"n": F.count("*"), "missing": F.sum(total([is_missing(df, c).cast("long") for c in df.columns]))}
    for c in numeric:
        exprs[("skew", c)] = skew_expr(c)
    got = one_row(df, exprs)
    nd = distinct_counts(df, strings) if strings else {}
    cells = max(1, got["n"] * len(df.columns))
    missing_pct = 100.0 * (got["missing"] or 0) / cells
    skews = [got[("skew", c)] for c in numeric if got[("skew", c)] is not None]
    rows: list[tuple[str, str, float]] = [
        ("shape", "rows", float(got["n"])), ("shape", "columns", float(len(df.columns))),
        ("missing", "high" if missing_pct > 30 else "moderate" if missing_pct > 5 else "low", missing_pct),
    ]
    per_type: dict[str, int] = {}
    for _, dtype in df.dtypes:
        per_type[dtype] = per_type.get(dtype, 0) + 1
    rows += [("dtype", t, float(k)) for t, k in sorted(per_type.items())]
    if skews:
        top = max(abs(s) for s in skews)
        rows += [
            ("skew", "min", min(skews)), ("skew", "max", max(skews)),
            ("scaling", "robust_or_log" if top > 2 else "robust" if top > 1 else "standard", top),
        ]
    if nd:
        high = sum(1 for v in nd.values() if v > 10)
        rows += [
            ("cardinality", "min", float(min(nd.values()))), ("cardinality", "max", float(max(nd.values()))),
            ("encoding", "frequency_or_target" if high else "onehot", float(high)),
        ]
    rows.append(("features", "interactions" if len(numeric) > 3 else "few_numeric", float(len(numeric))))
    if missing_pct > 5:
        rows.append(("recommend", "impute", missing_pct))
    if len(numeric) > 20:
        rows.append(("recommend", "reduce", float(len(numeric))))
    if strings:
        rows.append(("recommend", "encode", float(len(strings))))
    table = _table(df, rows, "topic string, rule string, value double")
    if target is not None:
        present = df.where(col(target).isNotNull())
        n = present.count()
        shares = present.groupBy(col(target).cast("string").alias("rule")).agg((F.count("*") / F.lit(float(n))).alias("value"))
        table = table.unionByName(shares.select(F.lit("target_share").alias("topic"), "rule", "value"))
    return table


def validate_nonempty(df: DataFrame | None) -> DataFrame | None:
    """The table itself if it has a column and a row; raises otherwise."""
    if df is None:
        raise ValueError("no table given")
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df
