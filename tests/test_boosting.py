"""Boosted trees against a plain version on the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import boosting


def frame(spark, x, y, w):
    rows = [(i, float(a), float(b), *(None if np.isnan(v) else float(v) for v in r)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "user_id long, y double, w double, " + ", ".join(f"x{i} double" for i in range(x.shape[1])))


def plain_tree(bins, g, h, depth, penalty, min_child):
    """Splits and leaf sums by trying every split of every node."""
    nodes, splits, leaves = {1: np.arange(len(g))}, {}, {}
    for level in range(depth):
        for node in [n for n in nodes if n >= 2**level and n < 2 ** (level + 1)]:
            rows, best = nodes[node], None
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                for cut in range(0, b.max() + 1):
                    for left_missing in (1, 0) if (b < 0).any() else (1,):
                        left = (b <= cut) if left_missing else (b >= 0) & (b <= cut)
                        gl, hl, gr, hr = g[rows[left]].sum(), h[rows[left]].sum(), g[rows[~left]].sum(), h[rows[~left]].sum()
                        if hl < min_child or hr < min_child:
                            continue
                        gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - (gl + gr) ** 2 / (hl + hr + penalty)
                        key = (round(gain, 9), -f, -cut, left_missing)
                        if gain > 1e-6 and (best is None or key > best[0]):
                            best = (key, rows[left], rows[~left], (f, cut, bool(left_missing)))
            if best is None:
                continue
            splits[node] = best[3]
            nodes[2 * node], nodes[2 * node + 1] = best[1], best[2]
    for node, rows in nodes.items():
        if node not in splits:
            leaves[node] = (rows, -g[rows].sum() / (h[rows].sum() + penalty))
    return splits, leaves


def plain_fit(bins, y, w, trees, depth, step, penalty=1.0, min_child=1.0):
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        splits, leaves = plain_tree(bins, w * (p - y), w * p * (1 - p), depth, penalty, min_child)
        for rows, value in leaves.values():
            margin[rows] += step * value
        out.append((splits, {n: step * v for n, (_, v) in leaves.items()}))
    return out, 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3))
    x[:, 2] = rng.integers(0, 4, 300)
    x[rng.random((300, 3)) < 0.05] = np.nan
    x = np.vstack([x, x[:20]])
    y = (np.nan_to_num(x[:, 0]) + 0.5 * np.nan_to_num(x[:, 1]) ** 2 + rng.normal(0, 0.3, 320) > 0.3).astype(float)
    return x, y, np.where(y == 1, 1.7, 1.0)


def test_trees_equal_a_plain_version(spark, data):
    x, y, w = data
    df = frame(spark, x, y, w)
    names = ["x0", "x1", "x2"]
    model = boosting.fit(df.repartition(5), names, "y", "w", trees=4, depth=3, bins=16)
    bins = np.array([[-1 if np.isnan(v) else sum(c <= v for c in cuts) for v, cuts in zip(r, model.cuts)] for r in x])
    found = boosting.binned(df, names, model.cuts).orderBy("user_id").collect()
    assert [r.bins for r in found] == bins.tolist()
    expected, scores = plain_fit(bins, y, w, 4, 3, 0.3)
    for tree, (splits, values) in zip(model.trees, expected, strict=True):
        assert tree.splits == splits
        assert {n: v for n, v in tree.values.items() if n not in splits} == pytest.approx(values, abs=1e-9)
    scored = model.transform(df).orderBy("user_id").toPandas()
    assert scored["score"].to_numpy() == pytest.approx(scores, abs=1e-9)
    assert (scored["prediction"] == (scores > 0.5)).all()
    again = boosting.fit(df.repartition(2).orderBy(F.desc("user_id")), names, "y", "w", trees=4, depth=3, bins=16)
    assert again.trees == model.trees and again.cuts == model.cuts


def test_cuts_are_weighted_quantiles(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(30_000, 1)), rng.choice([0.5, 2.0], 30_000)
    df = frame(spark, x, w, w).repartition(7)
    (cuts,) = boosting.cut_points(boosting.weighted_sketch(df, ["x0"], "w", points=512), 1, bins=32)
    order = np.argsort(x[:, 0])
    upto = np.cumsum(w[order]) / w.sum()
    ranks = [upto[np.searchsorted(x[order, 0], c)] for c in cuts]
    assert len(cuts) == 31
    assert ranks == pytest.approx([b / 32 for b in range(1, 32)], abs=3 / 512 + 1e-3)


def test_small_cases(spark):
    """A constant feature, one of missing values only, one class, no rows."""
    x = np.array([[1.0, np.nan, float(i % 2)] for i in range(40)])
    y = x[:, 2]
    names = ["x0", "x1", "x2"]
    df = frame(spark, x, y, np.ones(40))
    model = boosting.fit(df, names, "y", "w", trees=3, depth=4)
    assert all(s[0] == 2 for t in model.trees for s in t.splits.values())
    scored = model.transform(df).collect()
    assert all(r.prediction == r.y for r in scored)
    same = boosting.fit(df.withColumn("y", F.lit(1.0)), names, "y", "w", trees=3, min_child=0.0)
    assert same.trees == []
    none = boosting.fit(df.where("user_id < 0"), names, "y", "w")
    assert none.trees == [] and {r.score for r in none.transform(df).collect()} == {0.5}
    odd = df.withColumnRenamed("x2", "a b c")
    assert boosting.fit(odd, ["x0", "x1", "a b c"], "y", "w", trees=1).transform(odd).count() == 40
