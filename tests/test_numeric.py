"""Numeric operators for large or wide tables against plain numpy."""

import numpy as np
import pytest

from prepspark.functions import clusters
from prepspark.operators import eda, reduce, text, vector


def frame(spark, x, names=None):
    names = names or [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names))


def test_density_lies_within_its_bound(spark):
    rng = np.random.default_rng(0)
    v = {"a": np.concatenate([rng.standard_normal(500), [60.0]]), "b b": np.exp(2 * rng.standard_normal(501)), "same": np.full(501, 3.0)}
    df = frame(spark, np.column_stack([*v.values()]), list(v)).unionByName(spark.createDataFrame([(None, None, None)], "a double, `b b` double, same double"))
    got = eda.density(df).collect()
    assert {r["column"] for r in got} == {"a", "b b"}
    for c in ("a", "b b"):
        x = np.array(sorted((r.x, r.density) for r in got if r["column"] == c))
        h = v[c].std(ddof=1) * len(v[c]) ** -0.2
        peak = 1 / (h * np.sqrt(2 * np.pi))
        want = np.exp(-(((x[:, :1] - v[c]) / h) ** 2) / 2).mean(axis=1) * peak
        assert len(x) == 50 and np.abs(want - x[:, 1]).max() <= eda.density_error() * peak
        assert np.allclose([x[0, 0], x[-1, 0]], [v[c].min() - 3 * h, v[c].max() + 3 * h])
    coarse = eda.density(df, ["a"], terms=4)
    x = np.array(sorted((r.x, r.density) for r in coarse.collect()))
    h = v["a"].std(ddof=1) * 501**-0.2
    want = np.exp(-(((x[:, :1] - v["a"]) / h) ** 2) / 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
    assert 1e-9 < np.abs(want - x[:, 1]).max() * h * np.sqrt(2 * np.pi) <= eda.density_error(4)


@pytest.mark.parametrize("method", ["PCA", "SVD"])
def test_wide_projection_equals_the_exact_one(spark, method):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)) @ (rng.standard_normal((6, 300)) * 4) + rng.standard_normal((400, 300)) + 3
    x[rng.random(x.shape) < 0.01] = np.nan
    df = frame(spark, x).repartition(5)
    fit = reduce.fit_pca if method == "PCA" else reduce.fit_svd
    exact, blocks = fit(df, df.columns, 5), fit(df, df.columns, 5, wide_columns=100)
    assert np.allclose(exact.weights, blocks.weights, atol=1e-6) and np.allclose(exact.center, blocks.center) and abs(exact.explained - blocks.explained) < 1e-6


def test_wide_projection_of_odd_tables(spark):
    """No rows, fewer rows than vectors, equal columns, only one column varies."""
    flat = np.tile(np.arange(4.0), (6, 1))
    flat[:, 2] = [1, 5, 2, 2, 9, 4]
    p = reduce.fit_pca(frame(spark, flat), [f"x{i}" for i in range(4)], 2, wide_columns=1)
    assert np.allclose(p.weights[0], [0, 0, 1, 0]) and abs(p.explained - 1) < 1e-9
    none = reduce.fit_pca(frame(spark, flat).limit(0), [f"x{i}" for i in range(4)], 2, wide_columns=1)
    assert np.allclose(none.center, 0) and none.explained == 0
    two = reduce.fit_svd(frame(spark, flat[:2]), [f"x{i}" for i in range(4)], 3, wide_columns=1)
    assert len(two.weights) == 3 and np.allclose(np.array(two.weights) @ np.array(two.weights).T, np.eye(3), atol=1e-8)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_negation_and_strength_reach_the_next_word(spark, rows):
    """By a literal table and by a join."""
    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.7), ("great", 0.9, 0.8), ("the", None, None)], "word string, polarity double, subjectivity double").where("polarity IS NOT NULL")
    cases = {
        "good": (0.7, 0.6), "not good": (-0.35, 0.6), "very good": (0.91, 0.78), "not very good": (-0.35 / 1.3, 0.6 / 1.3), "It isn't GOOD.": (-0.35, 0.6), "not a good": (-0.35, 0.6),
        "not that good": (0.7, 0.6), "never bad": (0.35, 0.7), "very very great": (1.0, 1.0), "good, not bad": ((0.7 + 0.35) / 2, 0.65), "good not very": (0.7, 0.6), "nothing good": (0.7, 0.6),
        "": (0, 0), "not": (0, 0), "very": (0, 0), "slightly bad": (-0.35, 0.35), "not not good": (-0.35, 0.6),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "k int, t string")
    got = {r.t: (r.t_sentiment, r.t_subjectivity) for r in text.text_sentiment(df, "t", "k", lexicon, broadcast_rows=rows).collect()}
    for t, want in cases.items():
        assert np.allclose(got[t], want), t
    assert got[None] == (0, 0)


def test_a_middling_lexicon_moves_no_words(spark, monkeypatch):
    """Up to the bound the words stay where they are: the only exchange of the scores is by key."""
    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.7), ("great", 0.9, 0.8)], "word string, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "good not bad bad"), (2, None), (3, "great great tree")], "k int, t string")
    monkeypatch.setattr(text, "MAP_WORDS", 1)
    out = text.text_sentiment(df, "t", "k", lexicon, broadcast_rows=1)
    assert "word" not in " ".join(x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x or "hashpartitioning" in x)
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (round(r.t_sentiment, 9), round(r.t_subjectivity, 9)) for r in out.collect()}
    assert got == {1: (round((0.7 + 0.35 - 0.7) / 3, 9), round(2 / 3, 9)), 2: (0, 0), 3: (0.9, 0.8)}


@pytest.mark.parametrize("rows", [100_000, 2, 0])
def test_long_runs_of_acting_words(spark, monkeypatch, rows):
    """By a literal table, a broadcast and a shuffle: no run is too long to be read, and none has a strength that cannot be divided by."""
    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.7), ("great", 0.9, 0.8)], "word string, polarity double, subjectivity double")
    cases = {
        "very " * 20_000 + "good": (1, 1), "not " * 20_001 + "good": (-0.35, 0.6), "slightly " * 3_000 + "bad": (0, 0), "no " + "slightly " * 3_000 + "bad": (1, 1),
        "good " + "not " * 20_000: (0.7, 0.6), "not, very. " * 9_000 + "tree good": (0.7, 0.6), "very " * 500 + "slightly " * 100 + "bad": (-1, 1),
    }
    monkeypatch.setattr(text, "MAP_WORDS", 3 if rows > 2 else 0)
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r.k: (r.t_sentiment, r.t_subjectivity) for r in text.text_sentiment(df, "t", "k", lexicon, broadcast_rows=rows).drop("t").collect()}
    for k, (t, want) in enumerate(cases.items()):
        assert np.allclose(got[k], want), t[:40]


@pytest.mark.parametrize("rows, weight", [(0, None), (12, None), (12, "n"), (12, "same"), (12, "none")])
def test_a_large_lexicon_is_shared_by_frequency(spark, rows, weight):
    """Frequent words by broadcast, the others by shuffle: every word is looked up once, whatever its weight says; the lexicon is not repeated."""
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(150)] + ["very", "not", "slightly"]
    odds = 1 / np.arange(1, 154) ** 0.9
    odds[150:] = 0.2
    texts = [" ".join(rng.choice(names, rng.integers(0, 60), p=odds / odds.sum())) for _ in range(80)]
    data = [(None if k == 7 else k // 2 if k < 10 else k, t) for k, t in enumerate(texts)] + [(90, None), (91, "w140 w140"), (92, "w3"), (93, "z" * 1_200), (94, "unknown words")]
    df = spark.createDataFrame(data, "k int, t string").repartition(3)
    words = [f"w{i}" for i in range(0, 150, 2)] + ["w0", "w0", "w140", "z" * 1_200]
    lex = [(w, float(rng.uniform(-1, 1)), float(rng.uniform(0, 1)), int(rng.integers(0, 90)), 5, None) for w in words] + [(None, 1.0, 1.0, 99, 5, None)]
    lexicon = spark.createDataFrame(lex, "word string, polarity double, subjectivity double, n int, same int, none int")
    scored = lambda **o: text.text_sentiment(df, "t", "k", lexicon, **o)
    rounded = lambda out: sorted(((r.t or "", r.k or -1, round(r.t_sentiment, 9), round(r.t_subjectivity, 9)) for r in out.collect()))
    out = scored(broadcast_rows=rows, weight=weight)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rounded(out) == rounded(scored(broadcast_rows=40))  # the lexicon as a whole, by broadcast


@pytest.mark.parametrize("rows", [None, 3])
def test_sparse_vectors_equal_dense_ones(spark, rows):
    data = [(k, float(k * 7 % 13), k % 3 == 0 if k % 5 else None, f"v{k % 11}" if k % 4 else None, "one") for k in range(60)]
    df = spark.createDataFrame(data, "id int, x double, f boolean, `c c` string, same string")
    dense = {r.id: list(r.features) for r in vector.vectorize(df, ["id"], as_array=True).collect()}
    for r in vector.vectorize_sparse(df, ["id"], max_rows=rows).collect():
        full = [0.0] * r["size"]
        for i, v in zip(r["indices"], r["values"]):
            full[i] = v
        assert np.allclose(full, dense[r.id]) and r["indices"] == sorted(r["indices"]) and 0.0 not in r["values"]
    places = {(r["column"], r["value"]): r["index"] for r in vector.value_index(df, ["id"], rows).collect()}
    values = sorted({d[3] for d in data if d[3]})
    assert places == {("x", None): 0, ("f", None): 1, **{("c c", v): 2 + k for k, v in enumerate(values[1:])}}
    assert vector.vectorize_sparse(df.limit(0), ["id"], max_rows=rows).count() == 0


def lloyd(x, centers, rounds=300):
    """Centres and inertia of plain k-means."""
    for _ in range(rounds):
        d2 = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        label = d2.argmin(axis=1)
        moved = np.array([x[label == i].mean(axis=0) if (label == i).any() else centers[i] for i in range(len(centers))])
        if np.allclose(moved, centers, atol=1e-12):
            break
        centers = moved
    return centers, ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_clusters_against_plain_rounds(spark):
    """A fixed point, no worse than the best of twenty plain starts, whatever the partitions; a third of the rows is one point."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((150, 3)) + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 4], [7, 7, 7])] + [np.tile([3.0, 3.0, -8.0], (300, 1))])
    points = frame(spark, x).selectExpr("array(x0, x1, x2) AS xs")
    a, b = (clusters.fit_kmeans(points.repartition(n), [2, 3, 5], rounds=60, tol=1e-10) for n in (1, 7))
    for k in (2, 3, 5):
        again, inertia = lloyd(x, a[k].centers)
        assert a[k].centers.shape == (k, 3) and np.allclose(again, a[k].centers, atol=1e-6) and np.isclose(inertia, a[k].inertia)
        assert np.allclose(a[k].centers, b[k].centers, atol=1e-8)
        best = min(lloyd(x, x[rng.choice(len(x), k, replace=False)])[1] for _ in range(20))
        assert a[k].inertia <= best * 1.001
    given = clusters.fit_kmeans(points, [3], rounds=200, tol=1e-12, first=x[[0, 200, 400]])[3]
    want, cost = lloyd(x, x[[0, 200, 400]])
    assert np.allclose(sorted(want.tolist()), given.centers) and np.isclose(cost, given.inertia)


def test_clusters_of_odd_tables(spark):
    """No rows, fewer points than clusters, nulls and signed zeros."""
    empty = spark.createDataFrame([], "xs array<double>")
    assert clusters.fit_kmeans(empty, [2])[2].centers.shape[0] == 0
    few = spark.createDataFrame([([1.0, 0.0],), ([1.0, -0.0],), ([1.0, None],), ([4.0, 4.0],)], "xs array<double>")
    fit = clusters.fit_kmeans(few, [2, 3])
    assert fit[3].centers.tolist() == fit[2].centers.tolist() == [[1.0, 0.0], [4.0, 4.0]] and fit[3].inertia == 0
