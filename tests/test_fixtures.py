"""Small inputs with values computed by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prepspark.functions import ranks
from prepspark.functions.neighbors import nearest_vectors
from prepspark.operators import balance, bins, clean, eda, encode, profile, rowfeat, runs, scale, select, split, temporal, text
from prepspark.plans import prepare as flows

# parcels: every expected value below was worked out from these rows with numpy
ROWS = [
    (11, 3, 140, dt.datetime(2023, 5, 6), "arrived wet", "north", 0),
    (12, 8, 395, dt.datetime(2023, 5, 31), "no remarks", "south", 1),
    (13, 5, 210, dt.datetime(2023, 6, 4), "label torn", "north", 0),
    (14, 12, 520, dt.datetime(2023, 2, 27), "left at gate", "east", 1),
    (15, 7, 365, dt.datetime(2023, 8, 1), "box dented", "south", 1),
    (16, 10, 430, dt.datetime(2023, 9, 30), "signed twice", "north", 0),
]


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(ROWS, "parcel_id int, size int, cost int, sent timestamp, note string, depot string, late int")


def column(df, name, by="parcel_id"):
    return [r[name] for r in df.orderBy(by).collect()]


def near(values, digits=6):
    return [None if v is None else round(v, digits) for v in values]


def test_roles(parcels):
    roles = {}
    for r in profile.profile_roles(parcels).collect():
        roles.setdefault(r["role"], []).append(r["column"])
    assert roles["numeric"] == ["parcel_id", "size", "cost", "late"]
    assert roles["datetime"] == ["sent"]
    assert roles["categorical"] == ["note", "depot"]
    assert roles["binary"] == ["late"]
    assert "parcel_id" in roles["id_like"] and "note" in roles["id_like"]


def test_row_stats(parcels):
    out = rowfeat.row_stats(parcels)
    assert near(column(out, "numeric_mean")) == [38.5, 104.0, 57.0, 136.75, 97.0, 114.0]
    assert near(column(out, "numeric_std")) == [67.825757, 194.053257, 102.140426, 255.563919, 178.758683, 210.770017]
    assert column(out, "numeric_sum") == [154, 416, 228, 547, 388, 456]


def test_target_mean(parcels):
    out = encode.encode_target_mean(parcels, "depot", "cost")
    assert column(out, "depot_target_mean") == [260, 380, 260, 520, 380, 260]


def test_target_mean_by_fold(parcels):
    out = encode.encode_target_mean(parcels.withColumn("fold", F.col("parcel_id") % 2), "depot", "cost", "m", fold="fold")
    # north: 140 and 210 in one fold, 430 in the other; south: one in each; east has no other row and takes the overall mean
    assert near(column(out, "m")) == [430, 365, 430, round(2060 / 6, 6), 395, 175]


def test_skew_corr_vif_anova(parcels):
    assert {r["column"]: round(r["skew"], 6) + 0.0 for r in eda.skewness(parcels).collect()} == {
        "parcel_id": 0, "size": 0, "cost": -0.466586, "late": 0,
    }
    corr = {(r["a"], r["b"]): r["r"] for r in eda.corr_matrix(parcels, ["size", "cost"]).collect()}
    assert round(corr[("size", "cost")], 6) == 0.978768
    v = {r["column"]: round(r["vif"], 4) for r in eda.vif(parcels, ["parcel_id", "size", "cost"]).collect()}
    assert v == {"parcel_id": 11.6722, "size": 171.9189, "cost": 189.4264}
    f = {r["feature"]: round(r["score"], 6) for r in select.f_classif(parcels, "late").collect()}
    assert f == {"parcel_id": 0.038462, "size": 1.35, "cost": 2.809778}


def test_bins_and_scales(parcels):
    assert [round(e, 6) for e in bins.quantile_edges(parcels, ["size"])["size"]] == [3, 5, 7, 8, 10, 12]
    assert near(column(scale.scale_robust(parcels, ["size"]), "size")) == [-1.125, 0.125, -0.625, 1.125, -0.125, 0.625]
    assert near(column(scale.scale_standard(parcels, ["size"]), "size")) == [-1.506993, 0.167444, -0.837218, 1.506993, -0.167444, 0.837218]


def test_constant_column_scales(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k int, x double")
    for method in ("minmax", "standard", "robust"):
        assert column(scale.scale_normalize(df, method, ["x"]), "x", "k") == [0.0, 0.0, None]


def test_dates(parcels):
    out = temporal.datetime_parts_full(parcels)
    # 2023-05-06, 2023-06-04 and 2023-09-30 fall on a weekend; 2023-05-31 and 2023-09-30 end their months
    assert column(out, "sent_is_weekend") == [True, False, True, False, False, True]
    assert column(out, "sent_is_month_end") == [False, True, False, False, False, True]


def test_text_rules(spark):
    rows = [(i, i % 2, "k" + str(i % 3), "the lamp in room %d flickers whenever the heating starts up" % i, i / 4) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "id int, target int, kind string, story string, level double")
    got = {(r["column"], r["rule"]): r["is_text"] for r in profile.detect_text(df).collect()}
    assert got[("story", "a")] and not got[("kind", "a")]
    assert profile.pick_target(profile.collect_profile(df)) == "target"
    assert encode.encode_onehot(df, "kind").columns[-2:] == ["kind_k1", "kind_k2"]


def test_text_features(spark):
    df = spark.createDataFrame([(1, "Ab 12, cd\n\tÉx!"), (2, ""), (3, None)], "k int, t string")
    out = text.text_counts(text.text_basic(df, ["t"]), ["t"])
    assert column(out, "t_word_count", "k") == [4, 0, 0]
    assert column(out, "t_uppercase_count", "k") == [2, 0, 0] and column(out, "t_digit_count", "k") == [2, 0, 0]
    assert column(out, "t_special_count", "k") == [2, 0, 0] and column(out, "t_has_digits", "k") == [True, False, False]


def test_vocabulary_sequence_keeps_last_tokens(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, "a b z")], "k int, t string")
    assert [tuple(r) for r in text.text_vocab(df, "t").collect()] == [("a", 3, 1), ("b", 2, 2), ("c", 1, 3), ("z", 1, 4)]
    out = text.text_sequence(df, "t", size=4, max_length=2)
    # index of z is not below 4: it drops out; only the last two known tokens count
    assert column(out, "t_sequence_sum", "k") == [4, 3] and column(out, "t_sequence_length", "k") == [2, 2]


def test_run_events(spark):
    kinds = ["task"] * 5 + ["auto"] * 3 + ["prompt", "human", "correction"]
    second = ["task"] * 7 + ["prompt"] * 6 + ["auto"]
    rows = [(1, k) for k in kinds] + [(2, k) for k in second] + [(3, "other")]
    df = spark.createDataFrame(rows, "run_id int, kind string")
    got = {r["run_id"]: r for r in runs.run_autonomy(df).collect()}
    assert (got[1]["pdr"], got[1]["sas"], got[1]["cof"], got[1]["ptma"]) == (0.2, 0.75, 0.2, 0.5357)
    assert got[2]["ptma"] == 0.5385
    assert (got[3]["pdr"], got[3]["sas"], got[3]["cof"], got[3]["ptma"]) == (0, 0, 0, 0)


def test_split_arithmetic():
    assert split.part_sizes(10, 0.2) == (8, 2) and split.part_sizes(399, 0.2) == (319, 80)
    assert split.timeseries_bounds(10, 3) == [4, 6, 8] and split.timeseries_bounds(10, 5) == [5, 6, 7, 8, 9]
    assert split.class_quota({"a": 7, "b": 2, "c": 1}, 3) == {"a": 2, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        split.timeseries_bounds(3, 5)


def test_dealing_equals_one_by_one():
    """Runs of equal groups against placing every group into the lightest fold."""
    import random

    rng = random.Random(8)
    for _ in range(300):
        k = rng.randint(1, 6)
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 40))), reverse=True)
        plain, loads = [], [0] * k
        for s in sizes:
            i = min(range(k), key=lambda i: (loads[i], i))
            plain.append(i)
            loads[i] += s
        runs, own = [], [0] * k
        for s in sorted(set(sizes), reverse=True):
            n = sizes.count(s)
            for a, b, turn in split.deal(own, s, n):
                runs += [turn[j % len(turn)] for j in range(b - a)]
        assert runs == plain and own == loads


def test_kfold_group_equals_greedy(spark):
    df = spark.range(400).withColumn("g", F.floor(F.sqrt(F.col("id"))))
    out = split.kfold_group(df, "g", 4)
    got = {r["g"]: r["fold"] for r in out.select("g", "fold").distinct().collect()}
    import hashlib

    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    loads = [0] * 4
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(f"{g}|42".encode()).hexdigest())):
        i = min(range(4), key=lambda i: (loads[i], i))
        assert got[g] == i
        loads[i] += sizes[g]


def test_ranks_break_ties_by_row(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    seen = {tuple(map(tuple, ranks.rank_in_group(df.repartition(n), ranks.key_hash(["k"]), None).orderBy("v").collect())) for n in (1, 3, 7)}
    assert len(seen) == 1


def test_neighbours_of_many_groups(spark):
    """Over a thousand groups, one much larger: every point's neighbour is the nearest of its own group."""
    rows = [(str(g), [float(g * 10 + i * (i + 1))]) for g in range(1100) for i in range(3)] + [("big", [float(i * i)]) for i in range(500)]
    got = nearest_vectors(spark.createDataFrame(rows, "g string, vec array<double>"), 1, 50).collect()
    by: dict = {}
    for g, v in rows:
        by.setdefault(g, []).append(v[0])
    assert len(got) == len(rows)
    for r in got:
        rest = [x for x in by[r["g"]] if x != r["vec"][0]]
        assert abs(r["neighbours"][0][0] - r["vec"][0]) == min(abs(x - r["vec"][0]) for x in rest)


def test_long_values_keep_their_codes(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 2000)
    df = spark.range(60).select("id", *[F.concat(F.repeat(F.lit(c), 300), F.col("id") % n).alias(c) for c, n in (("a", 2), ("b", 4), ("c", 12))])
    out = encode.encode_categorical(df, exclude=["id"])
    assert out.where("a IS NULL OR c IS NULL").count() == 0 and out.select("c").distinct().count() == 12
    assert len([c for c in out.columns if c.startswith("b_")]) == 3
    made = encode.categorical_features(df, ["b"])
    assert len([c for c in made.columns if c.startswith("b_bbb")]) == 3


def test_null_column_and_text_targets(spark):
    df = spark.range(40).select("id", F.lit(None).cast("string").alias("none"), F.concat(F.lit("c"), F.col("id") % 13).alias("y"), *[(F.col("id") * i % 7).cast("double").alias(f"x{i}") for i in range(1, 6)])
    assert encode.encode_binary(df, "none").where("none IS NOT NULL").count() == 0
    assert len([c for c in select.select_k_best(df, "y", 3, ["id"]).columns if c.startswith("x")]) == 3
    assert eda.target_summary(df, "y").count() == 13


def test_one_outlier_asks_for_many_bins(spark):
    df = spark.range(2000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("x"))
    got = eda.histogram(df, ["x"], "auto", empty=False)
    assert got.count() <= 2000 and got.agg(F.sum("n")).first()[0] == 2000


def test_clean_policy_rules(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 4.0, None), (1, 2.0, "x")], "k int, v double, s string")
    assert sorted(map(tuple, clean.clean_policy(df).collect())) == [(1, 2.0, "x")]
    numeric_only = df.where("s IS NOT NULL")
    assert sorted(map(tuple, clean.clean_policy(numeric_only).collect())) == [(1, 2.0, "x"), (2, 2.0, "y")]
    nan = spark.createDataFrame([(1, float("nan"), "x"), (2, 4.0, "y")], "k int, v double, s string")
    assert sorted(map(tuple, clean.clean_policy(nan).collect())) == [(1, 4.0, "x"), (2, 4.0, "y")]


def test_impute_auto_drops_sparse_and_breaks_mode_ties(spark):
    rows = [(1, 1.0, "b", None), (2, None, "a", None), (3, 3.0, None, 1), (4, 10.0, "b", 1), (5, 3.0, "a", 1)]
    out = clean.impute_auto(spark.createDataFrame(rows, "k int, v double, s string, sparse int"))
    assert out.columns == ["k", "v", "s"]
    assert column(out, "v", "k") == [1.0, 3.0, 3.0, 10.0, 3.0] and column(out, "s", "k") == ["b", "a", "a", "b", "a"]


def test_cast_keeps_unconvertible_columns(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x")], "a string, b string")
    assert dict(clean.cast_columns(df, {"a": "int", "b": "int"}).dtypes) == {"a": "int", "b": "string"}


def test_validation(spark):
    empty = spark.createDataFrame([], "a int")
    for bad in (None, empty):
        with pytest.raises(ValueError):
            profile.validate_nonempty(bad)


def test_gamma_tail():
    assert round(eda.gamma_tail(1.0, 2.0), 9) == 0.135335283
    assert round(eda.gamma_tail(0.5, 3.841458820694124 / 2), 9) == 0.05
    assert round(eda.gamma_tail(5.0, 18.307038053275143 / 2), 9) == 0.05


def test_column_names_with_blanks_and_dots(spark):
    df = spark.createDataFrame([(1, 1.0, "u"), (2, 3.0, "v"), (3, 5.0, "u"), (4, 5.5, "w")], "k int, `a.b c` double, `s.t` string")
    assert round(column(scale.scale_minmax(df, ["a.b c"]), "a.b c", "k")[1], 6) == 0.444444
    assert "s.t_v" in encode.encode_categorical(df).columns
    assert profile.profile_missing(df).count() == 3


def test_edge_case_tables(spark):
    """Wide, sparse, unbalanced and text-heavy tables built from hashes."""
    base = spark.range(400)
    u = lambda tag: F.pmod(F.xxhash64("id", F.lit(tag)), F.lit(10_000)) / 10_000.0
    wide = base.select("id", *[u(f"f{i}").alias(f"feature_{i}") for i in range(25)], (F.col("id") % 20 == 0).cast("int").alias("target"))
    out = flows.transform_table(wide, "target", ["id"], options=flows.TransformOptions())
    sizes = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert sizes == {0: 20, 1: 20}
    sparse = base.select("id", *[F.when(u(f"m{i}") > 0.5, u(f"f{i}")).alias(f"feature_{i}") for i in range(6)], (F.col("id") % 2).alias("target"))
    assert flows.transform_table(sparse, "target", ["id"]).count() == 400
    texts = base.select("id", u("a").alias("x"), u("b").alias("y"), u("c").alias("z"), F.concat(F.lit("Sample text "), "id").alias("t"), (F.col("id") % 3).alias("target"))
    texts = texts.withColumn("text_col", F.repeat("t", 10)).drop("t")
    made = flows.feature_table(texts, "target", keys=["id"])
    assert made.count() == 400 and "id" in made.columns


def test_balance_dispatch(spark):
    assert balance.choose_balancing(100, 9) == "undersample"
    assert balance.choose_balancing(100, 25) == "smote"
    assert balance.choose_balancing(100, 50) == "oversample"
    # thirty classes of two, and one of three
    df = spark.range(63).withColumn("target", F.least(F.floor(F.col("id") / 2), F.lit(30)))
    assert balance.balance_data(df, ["id"], "target").groupBy("target").count().select("count").distinct().collect()[0][0] == 3
