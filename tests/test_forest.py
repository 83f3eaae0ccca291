import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparloom.operators import forest as f


def _plain_tree(keys, bins, y, seed, t, k, least, depth):
    """A tree by recursion over the rows themselves: (feature, bin, left, right) or the labels' shares."""
    draws = f.drawn(seed, t, keys)
    ones, n = draws @ y, draws.sum()
    weight = draws * np.prod([np.where(y[:, c] == 1, n / (2 * max(ones[c], 1)), n / (2 * max(n - ones[c], 1))) for c in range(y.shape[1])], axis=0)

    def gini(rows):
        w = weight[rows].sum()
        share = (weight[rows] @ y[rows]) / w
        return (2 * share * (1 - share) * w).mean()

    def grow(rows, path, level):
        shares = (weight[rows] @ y[rows]) / weight[rows].sum()
        if all(s < 1e-9 or s > 1 - 1e-9 for s in shares) or level >= depth:
            return shares
        for at in range(-(-bins.shape[1] // k)):
            best = (np.inf, -1, -1)
            for j in f.candidates(seed, t, path, bins.shape[1], at, k):
                for b in range(f.BINS - 1):
                    left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                    if len(left) >= least and len(right) >= least:
                        score = round(gini(left) + gini(right), 9)
                        if score < best[0]:
                            best = (score, int(j), b)
            if best[1] >= 0:
                _, j, b = best
                return j, b, grow(rows[bins[rows, j] <= b], 2 * path % (1 << 62), level + 1), grow(rows[bins[rows, j] > b], (2 * path + 1) % (1 << 62), level + 1)
        return shares

    return grow(np.flatnonzero(draws > 0), 1, 0)


def _as_nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.shares[node]
    return tree.feature[node], tree.cut[node], _as_nested(tree, tree.left[node]), _as_nested(tree, tree.right[node])


def _same(a, b):
    if len(a) == 4 and isinstance(a[0], int):
        return isinstance(b, tuple) and a[:2] == b[:2] and _same(a[2], b[2]) and _same(a[3], b[3])
    return not isinstance(b, tuple) and np.allclose(a, b, atol=1e-9)


def _table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), rng.random(n) < 0.3, np.zeros(n), rng.normal(size=n).round(1)])
    y = np.column_stack([(x[:, 0] + rng.normal(size=n) > 0.5), (x[:, 1] == 2) ^ (rng.random(n) < 0.1), x[:, 2] * (x[:, 4] > 0)]).astype(int)
    rows = [(i, [float(v) for v in x[i]], *map(int, y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, a int, b int, c int"), x, y


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_trees_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(f, "HELD_BYTES", held)
    df, x, y = _table(spark)
    made = f.MultiOutputForest(["a", "b", "c"], trees=3, seed=7, depth=6, per_node=2).fit(df.repartition(3), "id")
    assert [len(t) for t in made.thresholds][1:4] == [2, 1, 0]
    keys = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    bins = made._bin(x)
    for t in range(3):
        assert _same(_plain_tree(keys, bins, y, 7, t, 2, 2, 6), _as_nested(made.trees[t]))
    scores = np.mean([tr_shares(tree, bins) for tree in made.trees], axis=0)
    got = made.transform(df.withColumn("features", array_to_vector("features"))).orderBy("id").collect()
    assert np.allclose([[r.score_a, r.score_b, r.score_c] for r in got], scores)
    assert [[r.pred_a, r.pred_b, r.pred_c] for r in got] == (scores > 0.5).astype(int).tolist()


def tr_shares(tree, bins):
    node = f.leaf_of(tree.arrays(), bins)
    return np.array([tree.shares[i] for i in node])


def test_labels_are_split_for_together(spark):
    """A joint tree parts by what most labels need; trees of their own part each by its own."""
    n = 400
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (n, 2))
    y = np.column_stack([x[:, 0], x[:, 0], x[:, 1] ^ (rng.random(n) < 0.02)])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], *map(int, y[i])) for i in range(n)], "id long, features array<double>, a int, b int, c int")
    joint = f.MultiOutputForest(["a", "b", "c"], trees=4, depth=1, per_node=2).fit(df, "id")
    alone = f.MultiOutputForest(["c"], trees=4, depth=1, per_node=2).fit(df, "id")
    assert {t.feature[0] for t in joint.trees} == {0} and {t.feature[0] for t in alone.trees} == {1}


def test_rare_labels_weigh_as_much(spark):
    """One row in forty has the label; without balance no leaf would say so."""
    rows = [(i, [float(i % 10)], int(i % 10 == 3 and i // 10 % 4 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, rare int")
    got = f.MultiOutputForest(["rare"], trees=10, depth=4).fit(df, "id").transform(df).groupBy("features").agg(F.max("pred_rare").alias("p")).collect()
    assert {r.features[0] for r in got if r.p} == {3.0}


def test_odd_tables(spark):
    schema = "id long, features array<double>, a int, b int, score string"
    rows = [(1, [1.0], 1, None, "x"), (2, [2.0], 1, 0, "x"), (3, None, 0, 1, "x"), (None, [1.0], 1, 0, "x"), (2, [2.0], 1, 0, "x"), (5, [3.0], 1, 0, "x")]
    df = spark.createDataFrame(rows, schema)
    got = f.MultiOutputForest(["a", "b"], trees=12).fit(df, "id").transform(df).collect()
    assert all((r.pred_a, r.pred_b) == ((None, None) if r.features is None else (1, 0)) for r in got) and len(got) == 6
    empty = f.MultiOutputForest(["a", "b"], trees=2).fit(df.limit(0), "id").transform(df.limit(0))
    assert empty.count() == 0 and "score_b" in empty.columns
    blind = f.MultiOutputForest(["a"], trees=3).fit(df.withColumn("features", F.array().cast("array<double>")), "id")
    assert all(t.feature == [-1] for t in blind.trees)
