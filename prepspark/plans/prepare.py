"""Whole preparation runs composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, columns_of, numeric_columns, string_columns
from prepspark.operators import balance, bins, clean, eda, encode, profile, reduce, rowfeat, scale, select, split, temporal, text, vector
from prepspark.session import materialize, side_by_side


@dataclass(frozen=True)
class TransformOptions:
    scaling: str | None = "minmax"
    binning: bool = True
    reduction: bool = True
    balancing: bool = True
    text: bool = True
    max_categories: int = 10
    select_k: int = 20
    reduce_above: int = 15
    n_bins: int = 5
    exact: bool = True


@dataclass(frozen=True)
class FeatureOptions:
    text: bool = True
    datetimes: bool = True
    interactions: bool = True
    polynomial: bool = False
    clustering: bool = True
    selection: bool = True
    max_clusters: int = 5
    max_text_features: int = 10


def transform_table(
    df: DataFrame, target: str | None = None, keys: list[str] = (), text_columns: list[str] | None = None,
    options: TransformOptions = TransformOptions(),
) -> DataFrame:
    """Impute, dates, text, encode, scale, select, reduce, bin, balance, drop nested columns.

    Target and key columns pass through untouched. Text columns are dropped after
    their features exist. Fitted inputs are written once where a later step
    would recompute everything before it.
    """
    o = options
    prof = profile.collect_profile(df)
    info = profile.dataset_kind(df, prof)
    target = info["target"] if target is None else target
    keep = [c for c in [target, *keys] if c]
    texts = info["text_columns"] if text_columns is None else text_columns
    out = clean.impute_auto(clean.drop_nested_columns(df), exact=o.exact)
    texts = [c for c in texts if c in out.columns]
    out = temporal.datetime_parts(out, [c for c in columns_of(out, "datetime") if c not in keep])
    if o.text and texts:
        out = text.process_text_features(out, texts)
    out = out.withColumns({c: col(c).cast("int") for c in columns_of(out, "boolean", keep)}) if columns_of(out, "boolean", keep) else out
    # a text of many values is encoded by frequency: its digest counts the same and shuffles 32 bytes
    many = {p.name for p in prof if p.kind == "string" and p.distinct > 100 and (p.mean_length or 0) > 32}
    out = out.withColumns({c: F.md5(col(c)) for c in many if c in out.columns and c not in keep})
    out = encode.encode_categorical(out, o.max_categories, exclude=keep)
    out = out.drop(*[c for c in columns_of(out, "datetime") if c not in keep])
    out = materialize(out, "encoded")
    if o.scaling:
        out = scale.scale_normalize(out, o.scaling, exclude=keep, exact=o.exact)
    if target is not None and target in out.columns:
        out = select.select_k_best(out, target, o.select_k, exclude=list(keys))
    elif len(numeric_columns(out, keys)) > o.select_k:
        out = select.variance_threshold(out, exclude=list(keys))
    if o.reduction and len(out.columns) > o.reduce_above:
        features = numeric_columns(out, keep)
        if len(features) >= 5:
            method = reduce.zero_fraction(out, features).first()["method"]
            out = (reduce.reduce_svd if method == "SVD" else reduce.reduce_pca)(out, exclude=keep)
    if o.binning:
        out = bins.bin_discretize(out, o.n_bins, "quantile", exclude=keep, exact=o.exact)
    if o.balancing and target is not None and info["is_imbalanced"]:
        out = balance.balance_data(out, list(keys), target)
    return out


def feature_table(
    df: DataFrame, target: str | None = None, text_columns: list[str] | None = None, keys: list[str] = (),
    options: FeatureOptions = FeatureOptions(),
) -> DataFrame:
    """Profile, row statistics, text, dates, categories, interactions, clusters, selection."""
    o = options
    df = clean.drop_nested_columns(df)
    plain = df.drop(*keys)
    prof = profile.collect_profile(plain)
    roles = profile.roles_of(prof)
    target = profile.pick_target(prof, "features") if target is None else target
    numeric = [c for c in roles["numeric"] if c != target]
    texts = roles["text"] if text_columns is None else text_columns
    out = rowfeat.row_missing(rowfeat.row_stats(df, numeric), plain.columns) if numeric else df
    if o.text and texts:
        out = text.create_text_features(out, texts, max_features=o.max_text_features)
    if o.datetimes:
        out = temporal.datetime_parts_full(out, roles["datetime"])
    out = encode.categorical_features(out, [c for c in roles["categorical"] if c != target and c not in texts], target)
    if o.interactions:
        out = rowfeat.interaction_features(out, numeric, o.polynomial)
    out = materialize(out, "features")
    if o.clustering:
        out = reduce.cluster_features(out, numeric, o.max_clusters, with_pca=True)
    if o.selection and target is not None and target in out.columns:
        out = select.select_k_best(out, target, 20, exclude=list(keys))
    return out


@dataclass
class Prepared:
    """Tables of a whole run; each is lazy except where a stage was written."""

    cleaned: DataFrame
    transformed: DataFrame
    engineered: DataFrame
    report: DataFrame
    parts: DataFrame
    vectors: DataFrame
    status: dict[str, str] = field(default_factory=dict)


def prepare(df: DataFrame, keys: list[str], target: str | None = None, transform: TransformOptions | None = None) -> Prepared:
    """Clean, transform, engineer, explore, split, vectorise. A stage that fails ends the run with its error."""
    opts = transform or TransformOptions(scaling="auto", balancing=False)
    profile.validate_nonempty(df)
    cleaned = materialize(clean.clean_policy(df), "cleaned")
    texts = [p.name for p in profile.collect_profile(cleaned) if profile.is_text(p, "d")]
    transformed = materialize(transform_table(cleaned, target, keys, texts or None, opts), "transformed")
    rest = side_by_side(df.sparkSession, {
        "engineered": lambda: materialize(feature_table(transformed, target, keys=keys), "engineered"),
        "report": lambda: eda.eda_report(transformed.drop(*keys), target),
        "parts": lambda: split.split_auto(cleaned, keys, target),
    })
    engineered, report, parts = rest["engineered"], rest["report"], rest["parts"]
    keep = [c for c in [target, *keys] if c]
    wide = engineered.drop(*[c for c in string_columns(engineered, keep)])
    vectors = vector.vectorize(wide, exclude=keep)
    stages = ("ingestion", "cleaning", "transformation", "feature_engineering", "eda", "split", "vectorization")
    return Prepared(cleaned, transformed, engineered, report, parts, vectors, {s: "completed" for s in stages})
