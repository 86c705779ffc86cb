"""Properties that hold for any input, and brute-force checks of the scalable algorithms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepspark.functions import neighbors, ranks, stats
from prepspark.functions.lookups import lookup_join
from prepspark.operators import balance, bins, clean, eda, encode, reduce, scale, select, split, text


def hot_values(spark, n=6000):
    """A third of the rows share one value; some are missing."""
    v = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise((F.col("id") * 7919 % 1000) / 8.0)
    return spark.range(n).select("id", v.alias("x"))


@pytest.mark.parametrize("rows", [0, 5, 200])
def test_quantiles_by_narrowing_are_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_ROWS", max(1, rows))
    df = hot_values(spark)
    x = np.array([r["x"] for r in df.collect() if r["x"] is not None])
    probs = [0.0, 0.01, 0.25, 0.33, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(df, {"x": probs}, percentile_rows=0)["x"]
    assert np.allclose(got, np.quantile(x, probs))


def test_quantiles_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(1.5, None)] * 30, "a double, b double")
    assert stats.quantiles(df, {"a": [0.2, 0.9], "b": [0.5]}, percentile_rows=0) == {"a": [1.5, 1.5], "b": [None]}


def test_select_ranks_on_longs(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_ROWS", 10)
    df = spark.range(5000).select((F.col("id") * 1_000_003 % 5003).alias("v"))
    ordered = sorted(r["v"] for r in df.collect())
    wanted = [0, 1, 17, 2500, 4998, 4999]
    got = stats.select_ranks(df, {"v": (F.col("v"), wanted)})["v"]
    assert got == {r: ordered[r] for r in wanted}


@pytest.mark.parametrize("leaf", [1, 256])
def test_hash_cuts_take_exact_counts(spark, leaf, monkeypatch):
    monkeypatch.setattr(ranks, "LEAF_ROWS", leaf)
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))))
    sizes = ranks.group_sizes(df, "g")
    h = ranks.key_hash(["id"])
    wanted = {g: [0, 1, n // 3, n - 1, n] for g, n in sizes.items()}
    cuts = ranks.hash_cuts(df, h, wanted, sizes, "g")
    for g, rs in wanted.items():
        for r, t in zip(rs, cuts[g]):
            assert df.where((F.col("g") == g) & (h < F.lit(t))).count() == r


def test_repeated_keys_at_a_cut_are_an_error(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError):
        split.split_random(df, ["k"])


def test_global_rank_of_values(spark):
    df = spark.range(5000).select(F.concat(F.lit("same-prefix-"), F.col("id").cast("string")).alias("v")).distinct()
    got = {r["v"]: r["idx"] for r in ranks.rank_values(df, "v", target_rows=100).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_results_do_not_depend_on_partitioning(table, partitions):
    o = table("orders").repartition(partitions)
    test_keys = split.split_stratified(o, ["o_orderkey"], "o_orderpriority").where("part = 'test'").agg(F.sum("o_orderkey"), F.count("*")).first()
    folds = split.split_timeseries(o, "o_orderdate", ["o_orderkey"]).groupBy("fold").agg(F.sum("o_orderkey")).orderBy("fold").collect()
    under = balance.undersample(o, "o_orderpriority", ["o_orderkey"]).agg(F.sum("o_orderkey")).first()[0]
    over = balance.oversample(o, "o_orderpriority", ["o_orderkey"]).agg(F.sum("o_orderkey")).first()[0]
    seen = (tuple(test_keys), tuple(map(tuple, folds)), under, over)
    first = test_results_do_not_depend_on_partitioning.__dict__.setdefault("seen", seen)
    assert seen == first


def test_split_is_a_partition(table):
    o = table("orders")
    s = split.split_random(o, ["o_orderkey"])
    train, test = s.where("part = 'train'"), s.where("part = 'test'")
    assert test.count() == -(-o.count() // 5)
    assert train.select("o_orderkey").intersect(test.select("o_orderkey")).count() == 0
    assert train.count() + test.count() == o.count()


def test_kfold_group_with_many_groups(table):
    o = table("orders")
    out = split.kfold_group(o, "o_custkey", 3)
    assert out.groupBy("o_custkey").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    assert out.count() == o.count() and out.select("fold").distinct().count() == 3


def test_unscale_inverts_scale(table):
    item = table("lineitem").select("l_quantity", "l_extendedprice")
    for method in ("minmax", "standard", "robust"):
        s = scale.fit_scale(item, method)
        worst = scale.unscale(scale.apply_scale(item.withColumn("q", F.col("l_quantity")), s), s).agg(F.max(F.abs(F.col("q") - F.col("l_quantity")))).first()[0]
        assert worst < 1e-9


def test_onehot_row_sum_and_bins_monotone(table):
    item = table("lineitem")
    hot = encode.encode_onehot(item, "l_returnflag")
    assert hot.agg(F.max(F.col("l_returnflag_N") + F.col("l_returnflag_R"))).first()[0] == 1
    b = bins.bin_quantile(item.withColumn("x", F.col("l_extendedprice")), ["x"])
    spans = b.groupBy("x").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).orderBy("x").collect()
    assert all(a["hi"] <= c["lo"] for a, c in zip(spans, spans[1:]))


def test_kmeans_edges_match_plain_lloyd(spark):
    df = hot_values(spark, 1500)
    x = np.array([r["x"] for r in df.collect() if r["x"] is not None])
    edges = np.linspace(x.min(), x.max(), 6)
    centers = (edges[1:] + edges[:-1]) / 2
    for _ in range(300):
        label = np.abs(x[:, None] - centers[None, :]).argmin(axis=1)
        new = np.array([x[label == i].mean() if (label == i).any() else centers[i] for i in range(5)])
        shift, centers = ((new - centers) ** 2).sum(), np.sort(new)
        if shift <= 1e-4 * x.var():
            break
    want = [x.min(), *((centers[1:] + centers[:-1]) / 2), x.max()]
    assert np.allclose(bins.kmeans_edges(df, ["x"])["x"], want)


@pytest.mark.parametrize(("leaf", "part"), [(40, None), (40, 70), (5000, None)])
def test_neighbours_match_brute_force(spark, leaf, part):
    """Two groups, whole or in parts; a third of the first one is a single repeated vector."""
    h = lambda tag: F.pmod(F.xxhash64("id", F.lit(tag)), F.lit(1000)).cast("double")
    vec = F.when((F.col("id") % 3 == 0) & (F.col("id") < 600), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array(h("a"), h("b"), h("c") / 50))
    pts = spark.range(900).select((F.col("id") >= 600).cast("int").alias("g"), vec.alias("vec"))
    got = neighbors.nearest_vectors(pts, 5, leaf, part).collect()
    rows = pts.collect()
    for g in (0, 1):
        x = np.array([r["vec"] for r in rows if r["g"] == g])
        mine = [r for r in got if r["g"] == g]
        assert sum(r["n"] for r in mine) == len(x)
        for r in mine:
            v = np.array(r["vec"])
            want = np.sort(((x - v) ** 2).sum(axis=1))[1:6]
            have = np.sort([((np.array(w) - v) ** 2).sum() for w in r["neighbours"]])
            assert np.allclose(want, have)


def test_only_wanted_vectors_are_searched(spark):
    pts = spark.range(900).select((F.col("id") % 2).alias("g"), F.array((F.col("id") * 37 % 101).cast("double"), F.col("id").cast("double")).alias("vec"))
    wanted = pts.where("vec[1] % 50 = 0")
    for leaf in (40, 1000):
        every = {(r["g"], tuple(r["vec"])): (r["n"], r["neighbours"]) for r in neighbors.nearest_vectors(pts, 3, leaf).collect()}
        got = {(r["g"], tuple(r["vec"])): (r["n"], r["neighbours"]) for r in neighbors.nearest_vectors(pts, 3, leaf, wanted=wanted).collect()}
        assert len(got) == 18 and all(every[k] == v for k, v in got.items())


def test_wide_scores_read_plain_columns(spark, monkeypatch):
    """Blocks of columns with gaps, a far offset and classes that outgrow a task's memory equal one grouped aggregation."""
    df = spark.range(600).select((F.col("id") % 5).cast("double").alias("y"), *[
        F.when(F.col("id") % (i + 3) != 0, 1e6 * (i % 3) + F.col("id") * (i + 7) % 53 + (F.col("id") % 5) * i / 5).alias(f"x{i}") for i in range(39)],
        ((F.col("id") % 5) / 7 + 1e5).alias("x39"))
    cols = [f"x{i}" for i in range(40)]
    monkeypatch.setattr(select, "HELD_CELLS", 50)
    for fill in (None, 0.0):
        parts = select._class_moments(df, "y", cols, fill)
        wide = {r["feature"]: r["score"] for r in select.f_classif(df, "y", cols, fill).collect()}
        assert {r["t"] for r in parts.collect()} == {"0.0", "1.0", "2.0", "3.0", "4.0"}
        narrow = {r["feature"]: r["score"] for c in range(0, 40, 20) for r in select.f_classif(df, "y", cols[c:c + 20], fill).collect()}
        # the last column is constant in every class: no score, whatever the rounding
        assert wide.keys() == narrow.keys() and wide.pop("x39") is narrow["x39"] is None and all(np.isclose(wide[c], narrow[c]) for c in wide)


def test_smote_points_lie_between_class_neighbours(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 6 == 0).cast("int").alias("y"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 17 % 89).alias("b"),
    )
    out = balance.smote(df, "y", ["id"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 250, 1: 250}
    assert out.where("id IS NOT NULL").exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        balance.smote(df.where("y = 0 OR id < 12"), "y", ["id"])
    with pytest.raises(ValueError):
        balance.smote(df.withColumn("s", F.lit("x")), "y", ["id"])


def test_large_lookup_equals_broadcast_lookup(spark):
    """Beyond the bound the join shuffles, with hot, missing and unseen keys."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 500).cast("string"))
    df = spark.range(5000).withColumn("k", key)
    table = df.where(F.col("k").isNotNull() & (F.col("k") != "44")).groupBy(F.col("k").alias("__key")).agg(F.count("*").alias("n"), F.max("id").alias("v"))
    small = {(r["id"], r["v"]) for r in lookup_join(df, table, F.col("k")).collect()}
    large = {(r["id"], r["v"]) for r in lookup_join(df, table, F.col("k"), broadcast_rows=1).collect()}
    assert small == large and len(small) == 5000


def test_encoders_agree_for_small_and_large_tables(table):
    c = table("customer")
    for fn in (encode.encode_label, encode.encode_frequency):
        a = fn(c, "c_name", "out").select("c_custkey", "out")
        b = fn(c, "c_name", "out", max_rows=10).select("c_custkey", "out")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fit_on_another_table(table):
    p = table("part")
    train = p.where("p_partkey % 2 = 0")
    out = encode.encode_frequency(p, "p_brand", "f", fit_on=train.where("p_brand <> 'Brand#2'"))
    assert out.where("p_brand = 'Brand#2'").agg(F.max("f")).first()[0] == 0.0
    s = scale.scale_standard(train, ["p_size"], fit_on=p)
    assert abs(s.agg(F.avg("p_size")).first()[0]) > 0


def test_wide_paths_agree_with_narrow_ones(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("y"), *[(F.col("id") * (i * 2 + 3) % 101 / (i + 1.0)).alias(f"x{i}") for i in range(40)])
    cols = [f"x{i}" for i in range(40)]
    wide = {r["feature"]: r["score"] for r in select.f_classif(df, "y", cols).collect()}
    monkeypatch.setattr(select, "WIDE_COLUMNS", 100)
    narrow = {r["feature"]: r["score"] for r in select.f_classif(df, "y", cols).collect()}
    assert all(np.isclose(wide[c], narrow[c]) for c in cols)
    x = np.array([[r[c] for c in cols] for r in df.collect()])
    assert np.allclose(stats.gramian(df, cols), x.T @ x)
    r = {(q["a"], q["b"]): q["r"] for q in eda.corr_matrix(df, cols).collect()}
    assert np.allclose([[r[(a, b)] for b in cols] for a in cols], np.corrcoef(x.T))
    p = reduce.reduce_pca(df, 3, exclude=["id", "y"]).agg(*[F.var_samp(f"PCA_{i}") for i in (1, 2, 3)]).first()
    assert np.allclose(sorted(p, reverse=True), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])


def test_pca_does_not_depend_on_units_of_standardised_columns(table):
    item = table("lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    out = reduce.standard_pca(item, item.columns, 3)
    total = out.agg(*[F.var_pop(f"pca_{i}") for i in (1, 2, 3)]).first()
    assert abs(sum(total) - 3) < 1e-6


def test_cluster_distance_is_the_smallest(table):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    item = table("lineitem").select(*cols)
    s = scale.fit_scale(item, "standard", cols)
    centers = reduce.fit_clusters(scale.apply_scale(item, s), cols, [2, 3])
    out = reduce.cluster_features(item, cols, 3)
    x = np.array([[r[c] for c in cols] for r in out.collect()])
    z = (x - [s.center[c] for c in cols]) / [s.spread[c] for c in cols]
    for k in (2, 3):
        d = np.sqrt(((z[:, None, :] - np.array(centers[k])[None]) ** 2).sum(axis=2))
        assert np.allclose(d.min(axis=1), [r[f"cluster_k{k}_dist"] for r in out.collect()])


def test_distinct_counts_agree(table):
    item = table("lineitem")
    want = item.agg(*[F.count_distinct(c).alias(c) for c in item.columns]).first().asDict()
    assert stats.distinct_counts(item, item.columns) == want
    assert stats.decided_distinct_counts(item, cols=item.columns) == want


def test_sentiment_with_a_large_lexicon(table):
    docs = table("documents").select("doc_id", "text").limit(50)
    lex = docs.select(F.explode(text.word_tokens("text")).alias("word")).distinct().select(
        "word", (F.length("word") / 20.0).alias("polarity"), F.lit(0.5).alias("subjectivity"),
    )
    a = text.text_sentiment(docs, "text", "doc_id", lex).select("doc_id", F.round("text_sentiment", 9).alias("s"))
    b = text.text_sentiment(docs, "text", "doc_id", lex, broadcast_rows=5).select("doc_id", F.round("text_sentiment", 9).alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_table_diff_of_equal_tables_is_zero(table):
    o = table("orders")
    assert all(r["value"] == 0 for r in clean.table_diff(o, o, ["o_orderkey"]).collect())


def test_importance_sums_to_one(table):
    imp = reduce.rf_importance(table("customer").drop("c_name"), "c_mktsegment", trees=5, depth=3)
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1) < 1e-9
