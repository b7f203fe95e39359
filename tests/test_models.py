"""Fitted models: agreement with direct computation, and known structure found."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import autoencoder, fuzzy, lloyd, mixture, neighbours, partition, reduce as reduce_ops, ward
from basketlens.operators import validity
from basketlens.plans import churn as churn_plan, segmentation
from basketlens.operators.blocks import packed_blocks
from basketlens.session import durable

XY = ["x", "y"]


def same_groups(rows, label="cluster"):
    pairs = {(r.truth, r[label]) for r in rows}
    return len(pairs) == len({t for t, _ in pairs}) == len({c for _, c in pairs})


def direct_fuzzy(x, centres, m, error, limit):
    previous = None
    for _ in range(limit):
        d = np.maximum(((x[:, None] - centres[None]) ** 2).sum(2), 1e-30)
        u = d ** (-1 / (m - 1))
        u /= u.sum(1, keepdims=True)
        if previous is not None and np.linalg.norm(u - previous) < error:
            break
        previous = u
        w = u**m
        centres = (w.T @ x) / w.sum(0)[:, None]
    return centres, u


@pytest.mark.parametrize("m", [2.0, 1.5])
def test_fuzzy_matches_direct_iteration(blobs, m):
    x = blobs.orderBy("user_id").select(*XY).toPandas().to_numpy()
    models = fuzzy.fuzzy_cmeans(blobs, XY, [2, 3], m=m)
    first = fuzzy._first_centres(blobs, XY, 3, 42, "user_id")
    for c, model in models.items():
        centres, u = direct_fuzzy(x, first[:c], m, 0.005, 500)
        assert model.converged
        assert model.centres == pytest.approx(centres, abs=1e-8)
        assert model.fpc == pytest.approx((u**2).sum() / len(x), abs=1e-8)
        assert 1 / c <= model.fpc <= 1
        falls = np.diff(model.objectives)
        assert (falls <= 1e-9).all()
        labelled = model.transform(blobs).orderBy("user_id").collect()
        assert np.array([r.memberships for r in labelled]) == pytest.approx(u, abs=1e-8)
    assert same_groups(models[3].transform(blobs).collect())


def test_fuzzy_row_on_a_centre(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "user_id long, x double")
    model = fuzzy.FuzzyModel(("x",), np.array([[0.0], [4.0]]), 2.0, (), 0.0, True)
    rows = model.transform(df).orderBy("user_id").collect()
    assert rows[0].memberships == [1.0, 0.0]
    assert rows[1].memberships == pytest.approx([0.9, 0.1])
    passed = fuzzy.fuzzy_pass(df, ["x"], {2: model.centres}).orderBy("cluster").collect()
    assert [r.weight for r in passed] == pytest.approx([1.81, 0.01])
    assert validity.partition_coefficient(model.transform(df)).first()[0] == pytest.approx(0.91)


def test_fuzzy_ignores_partitioning(blobs):
    a = fuzzy.fuzzy_cmeans(blobs, XY, [3])[3].centres
    b = fuzzy.fuzzy_cmeans(blobs.repartition(5), XY, [3])[3].centres
    assert a == pytest.approx(b, abs=1e-9)


def test_fuzzy_needs_distinct_rows(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "user_id long, x double")
    with pytest.raises(ValueError, match="distinct"):
        fuzzy.fuzzy_cmeans(df, ["x"], [2])


def direct_ward(x, k):
    """Merge the pair with the smallest increase of squared error, one at a time."""
    groups = [[i] for i in range(len(x))]

    def error(g):
        return ((x[g] - x[g].mean(0)) ** 2).sum()

    while len(groups) > k:
        a, b = min(
            itertools.combinations(range(len(groups)), 2),
            key=lambda p: error(groups[p[0]] + groups[p[1]]) - error(groups[p[0]]) - error(groups[p[1]]),
        )
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", [0, 1])
def test_ward_matches_direct_merging(spark, seed):
    x = np.random.default_rng(seed).normal(size=(30, 2))
    df = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "user_id long, x double, y double"
    )
    rows = ward.ward(df, XY, range(2, 10)).collect()
    assert len(rows) == 30
    for k in range(2, 10):
        found = {}
        for r in rows:
            found.setdefault(r[f"cluster_{k}"], set()).add(r.user_id)
        assert {frozenset(g) for g in found.values()} == direct_ward(x, k)


def test_ward_on_micro_clusters(blobs):
    rows = ward.ward(blobs, XY, [2, 3], condense_to=12).collect()
    assert len(rows) == 120
    assert same_groups(rows, "cluster_3")
    assert len({r.cluster_2 for r in rows}) == 2


def test_merge_heights(spark):
    """Three groups on a line: the two near ones merge first, at known costs."""
    rows = [(0.0,)] * 2 + [(1.0,)] * 3 + [(10.0,)] * 5
    df = spark.createDataFrame(rows, "x double")
    centre = 3.0 / 5.0
    for finish in (4096, 1):
        heights = ward.merge_heights(df, ["x"], finish=finish)
        assert heights == pytest.approx([2 * 3 / 5 * 1.0, 5 * 5 / 10 * (10.0 - centre) ** 2])


def test_ward_rounds_are_exact(spark):
    """Distributed rounds give the heights and groups of merging on one machine."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, s, (m, 3)) for c, s, m in ((0, 1, 1500), (6, 0.5, 900), (-8, 2, 598))] + [[[90.0, 0, 0], [91.0, 0, 0]]])
    names = ["x0", "x1", "x2"]
    df = points(spark, x)
    merges = ward.ward_merges(np.ones(3000), x)
    heights = ward.merge_heights(df.repartition(5), names, finish=300, block_rows=200)
    assert heights == pytest.approx([h for h, _, _ in merges], rel=1e-9)
    found = ward.ward(df, names, [2, 3, 5, 9], finish=300, block_rows=200).orderBy("user_id").toPandas()
    parent = list(range(3000))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for done, (_, a, b) in enumerate(merges, 1):
        parent[root(b)] = root(a)
        if 3000 - done in (2, 3, 5, 9):
            groups[3000 - done] = [root(i) for i in range(3000)]
    for k, labels in groups.items():
        pairs = set(zip(labels, found[f"cluster_{k}"]))
        assert len(pairs) == k == len({c for _, c in pairs})


def test_ward_of_equal_and_tied_rows(spark):
    """Many equal rows and a grid of ties still take few rounds."""
    x = np.array([[i % 12, i // 12 % 12] for i in range(1000)], float)
    df = points(spark, np.concatenate([x, np.zeros((500, 2))]))
    heights = ward.merge_heights(df, ["x0", "x1"], finish=1, block_rows=16)
    assert len(heights) == 143 and heights[0] > 0
    rows = ward.ward(df, ["x0", "x1"], [2, 4], finish=8, block_rows=16).collect()
    assert len(rows) == 1500 and len({r.cluster_4 for r in rows}) == 4
    assert all(len({r.cluster_4 for r in rows if (r.x0, r.x1) == p}) == 1 for p in [(0.0, 0.0), (3.0, 4.0)])
    assert ward.ward(df.where("user_id < 0"), ["x0", "x1"], [2]).count() == 0


def test_kmeans_and_mixture_find_blobs(blobs):
    model = lloyd.kmeans(blobs, XY, [3], restarts=3)[3]
    assert same_groups(blobs.withColumn("cluster", model.label()).collect())
    models = mixture.gaussian_mixtures(blobs, XY, [2, 3])
    rows = mixture.with_labels(blobs, models).collect()
    assert len(rows) == 120 and same_groups(rows, "cluster_3")


def test_elbow_matches_inertia(blobs):
    costs = {r.k: r.inertia for r in partition.kmeans_elbow(blobs, XY, [2, 3]).collect()}
    assert costs[3] < costs[2]
    model = lloyd.kmeans(blobs, XY, [3], seed=partition.ELBOW_SEED)[3]
    assert validity.inertia(blobs.withColumn("cluster", model.label()), XY).first()[0] == pytest.approx(costs[3])


def direct_lloyd(x, centres, tolerance=1e-3):
    while True:
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        place = d.argmin(1)
        after = np.array([x[place == c].mean(0) if (place == c).any() else centres[c] for c in range(len(centres))])
        if ((after - centres) ** 2).sum(1).max() <= tolerance**2:
            return centres, d.min(1).sum()
        centres = after


def test_shared_passes_equal_separate_fits(spark):
    """All sizes and restarts together end where each would alone; partitioning changes
    nothing."""
    x = np.random.default_rng(14).normal(size=(500, 3)) * [3, 1, 1]
    names = ["x0", "x1", "x2"]
    df = points(spark, x)
    models = lloyd.kmeans(df, names, [2, 4, 7], restarts=3, block_rows=120)
    blocks = packed_blocks(df, names, "user_id", 120)
    starts = lloyd.first_centres(blocks, 3, [2, 4, 7], 3, 42)
    for j, k in enumerate((2, 4, 7)):
        fits = [direct_lloyd(x, s[j]) for s in starts]
        centres, cost = min(fits, key=lambda f: f[1])
        assert models[k].cost == pytest.approx(cost)
        assert models[k].centres == pytest.approx(centres, abs=1e-6)
    again = lloyd.kmeans(df.repartition(6), names, [2, 4, 7], restarts=3, block_rows=120)
    assert all((again[k].centres == models[k].centres).all() for k in models)
    few = lloyd.kmeans(df.limit(3), names, [2, 5])
    assert few[5].cost == pytest.approx(0.0, abs=1e-9)
    assert lloyd.kmeans(df.where("user_id < 0"), names, [2])[2].cost == 0.0


def test_mixtures_never_lose_likelihood(spark):
    """Fits of several sizes equal a plain EM, and the likelihood only grows."""
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal([0, 0], [1, 2], (200, 2)), rng.normal([4, 3], 0.7, (150, 2))])
    x = np.concatenate([x, np.tile([9.0, 9.0], (20, 1))])
    names = ["x0", "x1"]
    df = points(spark, x)
    models = mixture.gaussian_mixtures(df, names, [2, 3, 4], block_rows=100)
    for k, model in models.items():
        assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:]))
        m = model.mixture
        assert m.weights.sum() == pytest.approx(1) and np.linalg.eigvalsh(m.covariances).min() > 0
        _, likelihood = m.responsibilities(x)
        assert likelihood.mean() == pytest.approx(model.log_likelihood)
        density = sum(
            w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - u, np.linalg.inv(s), x - u)) / np.sqrt(np.linalg.det(2 * np.pi * s))
            for w, u, s in zip(m.weights, m.means, m.covariances)
        )
        assert np.exp(likelihood) == pytest.approx(density)
    assert max(len(m.history) for m in models.values()) > 3
    again = mixture.gaussian_mixtures(df.repartition(5), names, [3], block_rows=100)
    assert (again[3].mixture.means == models[3].mixture.means).all()


def test_minibatches_come_near_full_passes(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(c, 1, (400, 2)) for c in ([0, 0], [7, 0], [0, 7], [7, 7])])
    df = points(spark, x)
    models = lloyd.minibatch_kmeans(df, ["x0", "x1"], [2, 4], batch_rows=200)
    full = lloyd.kmeans(df, ["x0", "x1"], [2, 4], restarts=4)
    for k in (2, 4):
        assert models[k].cost < 1.05 * full[k].cost
    # one batch is the running mean of what each centre has taken
    centres, taken, cost = lloyd.batch_step(x[:400], np.array([[0.0, 0.0], [50.0, 50.0]]), np.array([100.0, 5.0]))
    assert centres[0] == pytest.approx(x[:400].sum(0) / 500) and (centres[1] == 50).all()
    assert taken.tolist() == [500, 5] and cost == pytest.approx((x[:400] ** 2).sum())


def test_pca_matches_svd(blobs):
    df = blobs.withColumn("z", F.col("x") * 0.3 + F.sin("y"))
    x = df.orderBy("user_id").select("x", "y", "z").toPandas().to_numpy()
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = np.sign(vt[np.arange(3), np.abs(vt).argmax(1)])
    expected = (x - x.mean(0)) @ (vt * signs[:, None]).T
    found = reduce_ops.pca(df, ["x", "y", "z"]).orderBy("user_id").toPandas()
    assert found[["pc1", "pc2", "pc3"]].to_numpy() == pytest.approx(expected, abs=1e-8)


def test_autoencoder_gradient():
    shapes = autoencoder._shapes(3, 4, 2)
    rng = np.random.default_rng(0)
    flat, x = autoencoder._start(shapes, 1) + rng.normal(0, 0.1, 53), rng.normal(size=(6, 3))
    _, gradient = autoencoder._loss_and_gradient(flat, shapes, x)
    for i in range(0, len(flat), 4):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, _ = autoencoder._loss_and_gradient(flat + step, shapes, x)
        down, _ = autoencoder._loss_and_gradient(flat - step, shapes, x)
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_autoencoder(blobs):
    scaled = durable(blobs.select("user_id", (F.col("x") / 5).alias("x"), (F.col("y") / 5).alias("y")))
    options = dict(rounds=4, learning_rate=0.03, block_rows=50, round_batches=20)
    model = autoencoder.train_autoencoder(scaled, XY, **options)
    assert len(model.flat) == 2 * 8 + 8 + 8 * 3 + 3 + 3 * 8 + 8 + 8 * 2 + 2
    assert len(model.losses) == 5 and model.losses[-1] < model.losses[0] / 2
    layers = autoencoder._unpack(model.flat, autoencoder._shapes(2, 8, 3))
    x = scaled.orderBy("user_id").select(*XY).toPandas().to_numpy()
    code = np.maximum(np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1], 0)
    found = model.transform(scaled).orderBy("user_id").toPandas()[["ae1", "ae2", "ae3"]]
    assert found.to_numpy() == pytest.approx(code, abs=1e-9)
    again = autoencoder.train_autoencoder(scaled.repartition(7), XY, **options)
    assert (again.flat == model.flat).all() and again.losses == model.losses


def test_autoencoder_averages_blocks(blobs):
    """Rounds over blocks equal a plain loop over the same blocks."""
    blocks = packed_blocks(blobs, XY, "user_id", 50)
    parts = {r.block: np.frombuffer(r.x).reshape(-1, 2) for r in blocks.collect()}
    assert len(parts) == 3 and sum(map(len, parts.values())) == 120
    shapes = autoencoder._shapes(2, 8, 3)
    state = np.zeros((3, 101))
    state[0] = autoencoder._start(shapes, 9)
    for number in range(3):
        after = [
            np.stack(autoencoder.train_block(x, *state, number * 10, shapes, 0.01, 10, [9, number, block])) * len(x)
            for block, x in parts.items()
        ]
        state = sum(after) / 120
    x = np.concatenate(list(parts.values()))
    model = autoencoder.train_autoencoder(blobs, XY, rounds=3, seed=9, starts=1, block_rows=50, round_batches=10)
    assert model.losses[-1] == pytest.approx(autoencoder._loss_and_gradient(state[0], shapes, x)[0], rel=1e-6)
    assert model.flat == pytest.approx(state[0], abs=1e-6)


def test_autoencoder_trains_until_the_loss_settles(spark):
    """Default settings end below a long run of full steps on one machine."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 7)) + rng.normal(0, 0.5, (400, 7))
    x = (x - x.mean(0)) / x.std(0)
    names = [f"x{i}" for i in range(7)]
    model = autoencoder.train_autoencoder(points(spark, x).coalesce(1), names)
    shapes = autoencoder._shapes(7, 8, 3)
    flat = autoencoder._start(shapes, 42)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, 3001):
        long, gradient = autoencoder._loss_and_gradient(flat, shapes, x)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        flat = flat - 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * first / (np.sqrt(second) + 1e-7)
    assert model.converged and len(model.losses) < autoencoder.ROUNDS
    assert min(model.losses) < 1.02 * long < model.losses[0]
    assert autoencoder.train_autoencoder(points(spark, x).where("user_id < 0"), names).losses == []


def points(spark, x):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user_id long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])))


@pytest.mark.parametrize("options", [{}, {"cells": 7, "block_rows": 11}])
def test_nearest_neighbours_are_exact(spark, options):
    x = np.round(np.random.default_rng(4).normal(size=(120, 3)), 1)
    x[7] = x[8] = x[9]
    near = neighbours.nearest_neighbours(points(spark, x), ["x0", "x1", "x2"], 5, **options).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        mine = near[near.user_id == i]
        assert len(mine) == 5 and i not in set(mine.neighbour)
        assert sorted(mine.distance) == pytest.approx(sorted(d[i])[:5])
        assert mine.distance.to_numpy() == pytest.approx(d[i, mine.neighbour.to_numpy()])
    assert near.weight.between(0, 1).all()
    edges = near.rename(columns={"user_id": "i", "neighbour": "j"})
    graph = neighbours.fuzzy_union(spark.createDataFrame(edges[["i", "j", "weight"]])).toPandas()
    w = np.zeros((120, 120))
    w[edges.i, edges.j] = edges.weight
    both = w + w.T - w * w.T
    assert (graph.weight > 0).sum() == (both > 0).sum()
    assert graph.weight.to_numpy() == pytest.approx(both[graph.i, graph.j])


def test_few_rows_are_all_neighbours(spark):
    df = points(spark, np.array([[0.0], [1.0], [3.0]]))
    near = neighbours.nearest_neighbours(df, ["x0"], 5).collect()
    assert sorted((r.user_id, r.neighbour, r.distance) for r in near) == [(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (1, 2, 2.0), (2, 0, 3.0), (2, 1, 2.0)]
    assert neighbours.nearest_neighbours(df.limit(1), ["x0"], 5).count() == 0
    assert neighbours.nearest_neighbours(df.where("user_id < 0"), ["x0"], 5).columns == ["user_id", "neighbour", "distance", "weight"]


def test_spectral_coordinates_match_dense(spark):
    x = np.random.default_rng(6).normal(size=(90, 3))
    near = neighbours.nearest_neighbours(points(spark, x), ["x0", "x1", "x2"], 12)
    edges = near.select(F.col("user_id").alias("i"), F.col("neighbour").alias("j"), "weight")
    graph = durable(neighbours.fuzzy_union(edges))
    found = np.array([r.spots for r in neighbours.spectral(graph, 3, residual=1e-4).orderBy("i").collect()])
    w = np.zeros((90, 90))
    for r in graph.collect():
        w[r.i, r.j] = r.weight
    root = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(w / root[:, None] / root[None, :])
    top = vectors[:, ::-1][:, 1:4]
    for c in range(3):
        assert abs(found[:, c] @ top[:, c]) == pytest.approx(1.0, abs=1e-5)


def test_embedding_places_every_row(blobs):
    out = neighbours.neighbour_embedding(blobs, XY, neighbours=45)
    joined = out.join(blobs, "user_id").collect()
    assert len(joined) == 120
    assert max(abs(v) for r in joined for v in (r.nb1, r.nb2, r.nb3)) == pytest.approx(10.0)
    # two axes tell three groups apart; the third one varies inside a group
    spots = {t: np.array([[r.nb1, r.nb2] for r in joined if r.truth == t]) for t in range(3)}
    for a, b in itertools.combinations(range(3), 2):
        gap = np.linalg.norm(spots[a].mean(0) - spots[b].mean(0))
        assert gap > 2 * max(spots[a].std(), spots[b].std())


@pytest.mark.parametrize(
    "sweep", [segmentation.kmeans_sweep, segmentation.minibatch_sweep, segmentation.ward_sweep, segmentation.fuzzy_sweep, segmentation.gmm_sweep]
)
def test_sweeps_prefer_the_true_count(blobs, sweep):
    rep = segmentation.Representation("raw", blobs.select("user_id", *XY), tuple(XY))
    scores = {r.k: r for r in sweep(rep, ks=[2, 3]).collect()}
    assert set(scores) == {2, 3} and scores[3].method == "raw"
    if sweep is not segmentation.gmm_sweep:
        assert scores[3].silhouette > scores[2].silhouette
        assert scores[3].davies_bouldin < scores[2].davies_bouldin
        assert scores[3].calinski_harabasz > scores[2].calinski_harabasz


def test_churn_run(spark):
    rng = np.random.default_rng(8)
    from basketlens.sources.schemas import FEATURES, ORDERS

    users = [(i, *map(float, rng.normal(10, 2, 7))) for i in range(300)]
    features = spark.createDataFrame(
        users, "user_id long, " + ", ".join(f"{c} double" for c in FEATURES)
    )
    orders = spark.createDataFrame(
        [(u[0], u[0], "prior", 1, 0, 0, 30.0 if u[1] > 10 else 1.0) for u in users], ORDERS
    )
    run = churn_plan.run_churn(features, orders, 20, trees=5, depth=3)
    assert run.scored.count() == 60
    areas = run.areas().first()
    assert areas.roc_auc > 0.9 and areas.average_precision > 0.9
    assert run.report().count() == 5
    assert run.confusion().agg(F.sum("n")).first()[0] == 60
    assert run.scored.where("score < 0 OR score > 1").count() == 0
