"""Encodings of categorical columns.

All columns of one call are counted in one pass: (column, value) -> rows and
target statistic. Few categories become literal comparisons. Many become a
lookup whose table is measured before Spark is told to broadcast it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, kinds, num, one_row, string_columns
from prepspark.functions.lookups import BROADCAST_BYTES, BROADCAST_ROWS, join_large, join_small, lookup_join
from prepspark.functions.ranks import rank_values

MISSING = "missing"
#: values that may become columns of their own
MAX_COLUMNS = 10_000


def category(name: str) -> Column:
    """Category as text, null as its own value."""
    return F.coalesce(col(name).cast("string"), F.lit(MISSING))


@dataclass
class Categories:
    """Values of one column with their rows ``n`` and target statistic ``stat``.

    ``rows`` holds them where they are few, ``table`` (on the executors) where not.
    """

    distinct: int
    total: int
    rows: list[tuple] | None
    table: DataFrame | None

    def values(self) -> list[str]:
        """Sorted values, for encodings that name every one of them; where the values are long they are fetched here."""
        return [r[0] for r in self.rows] if self.rows is not None else sorted(r["__key"] for r in self.table.select("__key").collect())


def fit_categories(
    df: DataFrame, cols: list[str], target: str | None = None, null_as: str | None = MISSING, max_rows: int | None = None,
) -> dict[str, Categories]:
    """Count all columns in one aggregation; fetch those whose value lists are small.

    A numeric target gives its mean per value, another one the share of its most
    common class. ``null_as`` names the value null counts as; None leaves null out.
    """
    if not cols:
        return {}
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    text = (lambda c: col(c).cast("string")) if null_as is None else (lambda c: F.coalesce(col(c).cast("string"), F.lit(null_as)))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in cols])).alias("r")
    if target is None:
        tall = df.select(cells).select("r.*").where(F.col("value").isNotNull())
        counted = tall.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("stat", F.lit(None).cast("double"))
    elif kinds(df)[target] == "numeric":
        tall = df.select(cells, num(target).alias("y")).select("r.*", "y").where(F.col("value").isNotNull())
        counted = tall.groupBy("column", "value").agg(F.count("*").alias("n"), F.avg("y").alias("stat"))
    else:
        tall = df.select(cells, col(target).cast("string").alias("y")).select("r.*", "y").where(F.col("value").isNotNull())
        pairs = tall.groupBy("column", "value", "y").agg(F.count("*").alias("c"))
        known = F.when(F.col("y").isNotNull(), F.col("c"))
        counted = pairs.groupBy("column", "value").agg(F.sum("c").alias("n"), (F.max(known) / F.sum(known)).alias("stat"))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {
        r["column"]: r
        for r in counted.groupBy("column").agg(
            F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.octet_length("value")).alias("b"),
        ).collect()
    }
    small, room, room_bytes = [], limit, BROADCAST_BYTES
    for c in sorted(sizes, key=lambda c: sizes[c]["k"]):
        if sizes[c]["k"] <= room and sizes[c]["b"] <= room_bytes:
            small.append(c)
            room, room_bytes = room - sizes[c]["k"], room_bytes - sizes[c]["b"]
    rows: dict[str, list[tuple]] = {c: [] for c in small}
    for r in counted.where(F.col("column").isin(small)).collect() if small else []:
        rows[r["column"]].append((r["value"], r["n"], r["stat"]))
    out = {}
    for c in cols:
        if c not in sizes:
            out[c] = Categories(0, 0, [], None)
        elif c in rows:
            out[c] = Categories(sizes[c]["k"], sizes[c]["n"], sorted(rows[c]), None)
        else:
            table = counted.where(F.col("column") == c).select(F.col("value").alias("__key"), "n", "stat")
            out[c] = Categories(sizes[c]["k"], sizes[c]["n"], None, table)
    if all(ct.rows is not None for ct in out.values()):
        counted.unpersist()
    return out


def attach(df: DataFrame, key: Column, fit: Categories, prefix: str = "__") -> DataFrame:
    """Add ``{prefix}code`` (index of the value), ``{prefix}freq`` (its share) and ``{prefix}stat``; null where unseen."""
    names = [f"{prefix}code", f"{prefix}freq", f"{prefix}stat"]
    total = float(max(1, fit.total))
    if fit.rows is not None:
        rows = [(v, i, n / total, stat) for i, (v, n, stat) in enumerate(fit.rows)]
        schema = f"__key string, {names[0]} long, {names[1]} double, {names[2]} double"
        return join_small(df, key, df.sparkSession.createDataFrame(rows, schema))
    ranked = rank_values(fit.table, "__key", names[0])
    table = ranked.withColumns({names[1]: F.col("n") / F.lit(total), names[2]: F.col("stat")}).drop("stat")
    return join_large(df, key, table)


def categories(df: DataFrame, name: str, limit: int | None = None) -> list[str]:
    """Sorted distinct non-null values as text. More than ``limit`` are an error, without one more than ``MAX_COLUMNS``: every
    value is to become a column, and a table cannot have more of them."""
    limit = MAX_COLUMNS if limit is None else limit
    rows = df.where(col(name).isNotNull()).select(col(name).cast("string").alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column '{name}' has more than {limit} values: use a frequency or label encoding, or sparse vectors")
    return sorted(r["v"] for r in rows)


def binary_column(name: str, vals: list[str]) -> Column:
    c = col(name).cast("string")
    if not vals:
        return F.lit(None).cast("int")
    code = F.when(c == F.lit(vals[-1]), F.lit(len(vals) - 1))
    return code.when(c == F.lit(vals[0]), F.lit(0)) if len(vals) == 2 else code


def onehot_columns(name: str, vals: list[str], drop_first: bool = True) -> dict[str, Column]:
    c = col(name).cast("string")
    return {f"{name}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in vals[1 if drop_first else 0:]}


def encode_binary(df: DataFrame, name: str, out: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Two values to 0/1 in sorted order; other values and nulls are null."""
    return df.withColumn(out or name, binary_column(name, categories(fit_on or df, name, 2)))


def encode_label(df: DataFrame, name: str, out: str | None = None, fit_on: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Index of the value among the sorted distinct values (null counts as 'missing')."""
    fit = fit_categories(fit_on or df, [name], max_rows=max_rows)[name]
    return attach(df, category(name), fit).withColumn(out or name, F.col("__code")).drop("__code", "__freq", "__stat")


def encode_onehot(
    df: DataFrame, name: str, drop_first: bool = True, keep: bool = False, fit_on: DataFrame | None = None, max_categories: int | None = None,
) -> DataFrame:
    """0/1 column ``{name}_{value}`` per sorted value, the first one dropped; null gives all zeros.

    As many columns as there are values; more than ``max_categories`` (``MAX_COLUMNS`` by default) are an error. ``vector.vectorize_sparse`` takes any number.
    """
    added = onehot_columns(name, categories(fit_on or df, name, max_categories), drop_first)
    kept = df.columns if keep else [c for c in df.columns if c != name]
    return df.select(*[col(c) for c in kept], *[e.alias(n) for n, e in added.items()])


def encode_frequency(
    df: DataFrame, name: str, out: str | None = None, fit_on: DataFrame | None = None, missing_as_value: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Share of the rows holding the value; unseen and (unless it counts as a value) null give 0."""
    fit = fit_categories(fit_on or df, [name], null_as=MISSING if missing_as_value else None, max_rows=max_rows)[name]
    key = category(name) if missing_as_value else col(name).cast("string")
    return attach(df, key, fit).withColumn(out or name, F.coalesce("__freq", F.lit(0.0))).drop("__code", "__freq", "__stat")


def encode_target_mean(
    df: DataFrame, name: str, target: str, out: str | None = None, fit_on: DataFrame | None = None, fold: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Mean of a numeric target per category, the overall mean where there is none.

    With ``fold`` (a column of fold numbers) each row's value comes from the rows
    of the other folds, so a row's own target never enters its feature.
    """
    source = fit_on or df
    y = num(target)
    overall = F.lit(source.agg(F.avg(y)).first()[0]).cast("double")
    out = out or f"{name}_target_mean"
    if fold is None:
        fit = fit_categories(source, [name], target, max_rows=max_rows)[name]
        return attach(df, category(name), fit).withColumn(out, F.coalesce("__stat", overall)).drop("__code", "__freq", "__stat")
    # sums per category and fold; a fold's value is what the rest of its category has, for any number of folds
    part = F.coalesce(col(fold).cast("string"), F.lit("\x00null"))
    by_fold = source.groupBy(category(name).alias("__cat"), part.alias("__f")).agg(F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.count(y).alias("c"))
    whole = by_fold.groupBy("__cat").agg(F.sum("n").alias("n"), F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    rest = by_fold.join(whole.drop("n"), "__cat")
    key = lambda f, cat: F.concat(f, F.lit("\x01"), cat)
    own = rest.select(key(F.col("__f"), F.col("__cat")).alias("__key"), "n", F.struct(
        F.try_divide(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c")).alias("v")).alias("__own"))
    every = whole.select(F.col("__cat").alias("__key"), "n", F.try_divide("all_s", "all_c").alias("__all"))
    joined = lookup_join(df, own, key(part, category(name)), broadcast_rows=max_rows)
    joined = lookup_join(joined, every, category(name), broadcast_rows=max_rows)
    # a fold without rows of the category leaves all of it
    stat = F.when(F.col("__own").isNotNull(), F.col("__own.v")).otherwise(F.col("__all"))
    return joined.withColumn(out, F.coalesce(stat, overall)).drop("__own", "__all")


def encode_target_prob(
    df: DataFrame, name: str, target: str, out: str | None = None, fit_on: DataFrame | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Share of the most common class of a non-numeric target per category, 0 where there is none."""
    fit = fit_categories(fit_on or df, [name], target, max_rows=max_rows)[name]
    return attach(df, category(name), fit).withColumn(out or f"{name}_target_prob", F.coalesce("__stat", F.lit(0.0))).drop("__code", "__freq", "__stat")


def choose_encoding(distinct: int, max_categories: int = 10) -> str:
    if distinct == 2:
        return "binary"
    if 3 <= distinct <= max_categories:
        return "onehot"
    return "frequency" if distinct > 50 else "label"


def encode_categorical(
    df: DataFrame, max_categories: int = 10, cols: list[str] | None = None, exclude: list[str] = (), fit_on: DataFrame | None = None,
) -> DataFrame:
    """Encode every string column by its distinct count: 2 binary, 3 to 10 one-hot, above 50 frequency, else label.

    One counting pass for all columns; dummies stand where their column stood last.
    """
    cols = string_columns(df, exclude) if cols is None else cols
    fits = fit_categories(fit_on or df, cols, null_as=None)
    dummies: dict[str, Column] = {}
    drop = []
    hows = {c: choose_encoding(fits[c].distinct, max_categories) for c in cols}
    labels = [c for c in cols if hows[c] == "label"]
    gaps = one_row(fit_on or df, {c: F.count_if(col(c).isNull()) for c in labels}) if labels else {}
    for c in cols:
        fit, how = fits[c], hows[c]
        # named values are few by the choice above, however long they are
        vals = fit.values() if how != "frequency" else []
        if how == "binary":
            df = df.withColumn(c, binary_column(c, vals))
        elif how == "onehot":
            dummies.update(onehot_columns(c, vals))
            drop.append(c)
        elif how == "frequency":
            df = attach(df, col(c).cast("string"), fit).withColumn(c, F.coalesce("__freq", F.lit(0.0))).drop("__code", "__freq", "__stat")
        else:
            known = sorted({*vals, MISSING}) if gaps[c] else vals
            table = Categories(len(known), fit.total, [(v, 0, None) for v in known], None)
            df = attach(df, category(c), table).withColumn(c, F.col("__code")).drop("__code", "__freq", "__stat")
    kept = [col(c) for c in df.columns if c not in drop]
    return df.select(*kept, *[e.alias(n) for n, e in dummies.items()]) if dummies else df


def categorical_features(df: DataFrame, cols: list[str], target: str | None = None, fit_on: DataFrame | None = None, max_categories: int = 10) -> DataFrame:
    """``_encoded``, ``_freq``, ``_target_mean`` or ``_target_prob`` and dummies beside each column.

    One counting pass for all columns, one lookup per column.
    """
    source = fit_on or df
    own = [c for c in cols if c == target]
    fits = {**fit_categories(source, [c for c in cols if c != target], target), **fit_categories(source, own)}
    numeric = target is not None and kinds(df)[target] == "numeric"
    overall = source.agg(F.avg(num(target))).first()[0] if numeric else 0.0
    dummies: dict[str, Column] = {}
    for c in cols:
        fit = fits[c]
        df = attach(df, category(c), fit)
        added = {f"{c}_encoded": F.col("__code"), f"{c}_freq": F.coalesce("__freq", F.lit(0.0))}
        if target is not None and c != target:
            added[f"{c}_target_mean" if numeric else f"{c}_target_prob"] = F.coalesce("__stat", F.lit(overall).cast("double"))
        df = df.withColumns(added).drop("__code", "__freq", "__stat")
        if fit.distinct <= max_categories:
            key = category(c)
            dummies.update({f"{c}_{v}": (key == F.lit(v)).cast("int") for v in fit.values()[1:]})
    return df.select("*", *[e.alias(n) for n, e in dummies.items()]) if dummies else df
