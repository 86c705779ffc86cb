"""Class balancing: over-, under- and synthetic sampling, reproducible from a seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, num, numeric_columns, one_row
from prepspark.functions.lookups import lookup_join
from prepspark.functions.neighbors import nearest_vectors
from prepspark.functions.ranks import below_cuts, group_sizes, group_text, hash_cuts, key_hash, rank_in_group, size_table
from prepspark.operators.profile import collect_profile, pick_target
from prepspark.session import materialize

#: hex digits turned into a draw: 13 digits are exact in a double
_DIGITS = 13


def _draw_number(*parts: Column) -> Column:
    """Whole number in [0, 16^13) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS), 16, 10).cast("long")


#: draws of a class that one row of the draw table unfolds
_CHUNK = 100_000


@dataclass
class _Classes:
    """Class sizes as a table (g, n) with the number of classes and the smallest and largest size."""

    table: DataFrame
    count: int
    least: int
    most: int


def _classes(df: DataFrame, target: str) -> _Classes:
    table = size_table(df.where(col(target).isNotNull()), target)
    got = table.agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if not got["k"]:
        raise ValueError(f"target '{target}' has no values")
    return _Classes(table, got["k"], got["lo"], got["hi"])


def _draws(classes: _Classes, seed: int) -> DataFrame:
    """(__g, __j, __rank): for every class the draws it lacks to the largest one, unfolded in chunks that are spread first."""
    need = F.lit(classes.most) - F.col("n")
    chunks = classes.table.where(need > 0).select(
        F.col("g").alias("__g"), F.col("n").alias("__size"), need.alias("__need"), F.explode(F.sequence(F.lit(0), F.floor((need - 1) / _CHUNK).cast("int"))).alias("__c"))
    first = F.col("__c").cast("long") * _CHUNK
    j = F.explode(F.sequence(first, F.least(F.col("__need"), first + _CHUNK) - 1))
    drawn = chunks.repartition("__g", "__c").select("__g", "__size", j.alias("__j"))
    rank = F.pmod(_draw_number(F.col("__g"), F.col("__j").cast("string"), F.lit(str(seed))), F.col("__size"))
    return drawn.select("__g", "__j", rank.alias("__rank"))


def _smaller(df: DataFrame, target: str, classes: _Classes) -> DataFrame:
    """Rows of the classes below the largest size."""
    small = classes.table.where(F.col("n") < classes.most).select(F.col("g").alias("__key"), "n", F.lit(True).alias("__small"))
    return lookup_join(df, small, group_text(target)).where("__small").select(*[col(c) for c in df.columns])


def oversample(df: DataFrame, target: str, keys: list[str], seed: int = 42) -> DataFrame:
    """All rows, plus draws with replacement until every class is as large as the largest.

    A draw is a rank inside its class; ranks and draws meet in an equi-join on
    (class, rank), both sides spread evenly, for any number of classes.
    """
    classes = _classes(df, target)
    if classes.least == classes.most:
        return df
    ranked = rank_in_group(_smaller(df, target, classes), key_hash(keys or df.columns, seed), target, "__rank")
    extra = ranked.withColumn("__g", group_text(target)).join(_draws(classes, seed), ["__g", "__rank"])
    return df.unionByName(extra.select(*[col(c) for c in df.columns]))


def undersample(df: DataFrame, target: str, keys: list[str], seed: int = 42, max_classes: int | None = None) -> DataFrame:
    """Every class cut to the size of the smallest: its lowest key hashes."""
    known = df.where(col(target).isNotNull())
    h = key_hash(keys or df.columns, seed)
    sizes = group_sizes(known, target, max_classes)
    if sizes is None:
        # too many classes for cuts on the driver: ranks inside classes give the same rows
        ranked = rank_in_group(known, h, target, "__rank")
        return ranked.where(F.col("__rank") < _classes(df, target).least).select(*[col(c) for c in df.columns])
    if not sizes:
        raise ValueError(f"target '{target}' has no values")
    cuts = hash_cuts(known, h, {g: [min(sizes.values())] for g in sizes}, sizes, target)
    source, reached = below_cuts(known, h, cuts, target)
    return source.where(reached == 0).select(*[col(c) for c in df.columns])


def smote(df: DataFrame, target: str, keys: list[str], k: int = 5, seed: int = 42, leaf_points: int | None = None) -> DataFrame:
    """All rows, plus points between a drawn row and one of its k nearest rows of the same class.

    All columns but target and keys must be numeric and free of nulls. Added
    rows have null keys. Neighbours are exact. Without keys a row's own cells
    decide its draw position.
    """
    features = numeric_columns(df, [target, *keys])
    others = [c for c in df.columns if c not in (*features, target, *keys)]
    if others:
        raise ValueError(f"synthetic rows need numeric features, not {others}")
    gaps = one_row(df.where(col(target).isNotNull()), {c: F.count_if(num(c).isNull()) for c in features})
    if any(gaps.values()):
        raise ValueError(f"synthetic rows need features without gaps, not {[c for c in features if gaps[c]]}")
    classes = _classes(df, target)
    if classes.least == classes.most:
        return df
    short = [r["g"] for r in classes.table.where((F.col("n") < classes.most) & (F.col("n") <= k)).orderBy("g").limit(10).collect()]
    if short:
        raise ValueError(f"classes {short} have no {k} neighbours")
    part = _smaller(df, target, classes)
    vec = F.array(*[num(c) for c in features])
    ranked = rank_in_group(part, key_hash(keys or df.columns, seed), target, "__rank").select(
        group_text(target).alias("__g"), col(target).alias("__t"), "__rank", vec.alias("__vec"),
    )
    # only drawn rows need neighbours
    base = materialize(ranked.join(_draws(classes, seed), ["__g", "__rank"]), "drawn")
    wanted = base.select(F.col("__g").alias("g"), F.col("__vec").alias("vec"))
    near = nearest_vectors(part.select(group_text(target).alias("g"), vec.alias("vec")), k, leaf_points, wanted=wanted)
    text_key = lambda g, v: F.md5(F.concat(g, F.lit("\x01"), F.array_join(F.transform(v, lambda x: x.cast("string")), ",")))
    table = near.select(text_key(F.col("g"), F.col("vec")).alias("__key"), "n", "neighbours")
    base = base.withColumn("__vkey", text_key(F.col("__g"), F.col("__vec")))
    joined = lookup_join(base, table, F.col("__vkey"))
    j = F.col("__j").cast("string")
    pick = F.pmod(_draw_number(F.col("__g"), j, F.lit(f"{seed}n")), F.lit(k))
    u = _draw_number(F.col("__g"), j, F.lit(f"{seed}u")) / F.lit(float(16**_DIGITS))
    types = dict(df.dtypes)
    made = joined.withColumns({"__nb": F.get("neighbours", pick.cast("int")), "__u": u})
    values = {
        c: (F.get("__vec", F.lit(i)) + F.col("__u") * (F.get("__nb", F.lit(i)) - F.get("__vec", F.lit(i)))).cast(types[c])
        for i, c in enumerate(features)
    }
    columns = [
        values[c].alias(c) if c in values else F.col("__t").alias(c) if c == target else F.lit(None).cast(types[c]).alias(c)
        for c in df.columns
    ]
    return df.unionByName(made.select(*columns))


def choose_balancing(most: int, least: int) -> str:
    ratio = most / least
    return "undersample" if ratio > 10 else "smote" if ratio > 3 else "oversample"


def balance_data(df: DataFrame, keys: list[str], target: str | None = None, method: str = "auto", seed: int = 42) -> DataFrame:
    """Balance a target of two classes or more; a table with fewer is returned as it is.

    ``auto`` undersamples above a ratio of 10, synthesises above 3 and
    oversamples below.
    """
    if target is None:
        target = pick_target(collect_profile(df), "transform")
    if target is None:
        return df
    classes = _classes(df, target)
    if classes.count < 2:
        return df
    method = choose_balancing(classes.most, classes.least) if method == "auto" else method
    if method == "oversample":
        return oversample(df, target, keys, seed)
    if method == "undersample":
        return undersample(df, target, keys, seed)
    if method == "smote":
        return smote(df, target, keys, seed=seed)
    raise ValueError(f"unknown method '{method}'")
