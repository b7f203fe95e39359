"""The point layout, the placing of new rows, and bootstrap bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import explore, layout, neighbours
from basketlens.session import durable

NAMES = [f"x{i}" for i in range(5)]


def frame(spark, x, first=0):
    rows = [(first + i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user_id long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])))


def trustworthiness(x, low, k=15):
    """Share of low-dimensional neighbours that are near in the full space, by ranks."""
    n = len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    near = ((low[:, None] - low[None]) ** 2).sum(2)
    np.fill_diagonal(far, -1.0)
    np.fill_diagonal(near, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    chosen = np.argsort(near, axis=1)[:, :k]
    late = np.maximum(np.take_along_axis(rank, chosen, 1) - k, 0).sum()
    return 1 - 2 * late / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def curved():
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(size=(60, 5)) * 0.6 + rng.normal(size=5) * 2 for _ in range(6)])


def spots(df, prefix):
    rows = df.orderBy("user_id").collect()
    return np.array([[r[f"{prefix}{c}"] for c in (1, 2, 3)] for r in rows])


def test_layout_keeps_neighbours_better_than_the_spectrum(spark, curved):
    near = neighbours.nearest_neighbours(frame(spark, curved), NAMES)
    edges = near.select(F.col("user_id").alias("i"), F.col("neighbour").alias("j"), "weight")
    graph = durable(neighbours.fuzzy_union(edges))
    start = durable(neighbours.scaled_spectral(graph, 3, residual=1e-2))
    plain, found = (
        np.array([r.spots for r in df.orderBy("i").collect()]) for df in (start, layout.laid_out(graph, start, 3, epochs=20))
    )
    assert found.shape == (360, 3) and np.isfinite(found).all()
    assert trustworthiness(curved, found) > max(0.9, trustworthiness(curved, plain))


def test_moves_do_not_depend_on_partitions(spark, curved):
    near = neighbours.nearest_neighbours(frame(spark, curved), NAMES)
    edges = near.select(F.col("user_id").alias("i"), F.col("neighbour").alias("j"), F.round("weight", 9).alias("weight"))
    graph = durable(edges)
    start = durable(frame(spark, curved).select(F.col("user_id").alias("i"), F.array("x0", "x1", "x2").alias("spots")))
    once = layout.laid_out(graph, start, 3, epochs=3, crowd_rows=50).orderBy("i").collect()
    again = layout.laid_out(graph.repartition(7), start.repartition(5), 3, epochs=3, crowd_rows=50).orderBy("i").collect()
    assert once == again


def test_an_epoch_is_the_direct_step(spark):
    """One epoch over certain edges and one crowd, against the formula for every pair."""
    rng = np.random.default_rng(9)
    at = rng.normal(size=(6, 3))
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0)]
    edges = spark.createDataFrame([(a, b, 0.5) for p in pairs for a, b in (p, p[::-1])], "i long, j long, weight double")
    start = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(at)], "i long, spots array<double>")
    rows = layout.laid_out(edges, start, 3, epochs=1).orderBy("i").collect()
    a, b = layout.CURVE_A, layout.CURVE_B
    for i, row in enumerate(rows):
        pull, stiff, drawn = np.zeros(3), 0.0, 0
        for p in pairs:
            if i in p:
                gap = at[p[0] + p[1] - i] - at[i]
                far = gap @ gap
                size = 2 * a * b * far ** (b - 1) / (1 + a * far**b)
                pull, stiff, drawn = pull + size * gap, stiff + size, drawn + 1
        push = np.zeros(3)
        for j in range(6):
            if j != i:
                gap = at[i] - at[j]
                far = gap @ gap
                push += np.clip(2 * b / ((0.001 + far) * (1 + a * far**b)) * gap, -4, 4) / 5
        step = np.clip((pull + 5 * drawn * push) / stiff, -4, 4) if drawn else np.zeros(3)
        assert row.spots == pytest.approx(at[i] + step, abs=1e-6)


def test_layout_of_few_rows(spark):
    df = frame(spark, np.array([[0.0], [1.0], [1.0], [4.0], [9.0]]))
    assert layout.neighbour_layout(df.limit(1), ["x0"]).count() == 0
    none = layout.neighbour_layout(df.where("user_id < 0"), ["x0"])
    assert none.columns == ["user_id", "ly1", "ly2", "ly3"] and none.count() == 0


@pytest.mark.parametrize("options", [{}, {"cells": 6, "block_rows": 13}])
def test_nearest_known_rows_are_exact(spark, curved, options):
    new = np.random.default_rng(2).normal(size=(40, 5)) * 3
    near = neighbours.nearest_known(frame(spark, new), frame(spark, curved), NAMES, 7, **options).toPandas()
    assert len(near) == 40 * 7
    full = np.sqrt(((new[:, None] - curved[None]) ** 2).sum(2))
    for i, mine in near.groupby("user_id"):
        mine = mine.sort_values(["distance", "neighbour"])
        assert mine.distance.to_numpy() == pytest.approx(np.sort(full[i])[:7])
        assert mine.distance.to_numpy() == pytest.approx(full[i, mine.neighbour.to_numpy()])


def test_nearest_known_of_few_rows(spark):
    known = frame(spark, np.array([[0.0], [2.0]]))
    near = neighbours.nearest_known(frame(spark, np.array([[0.0]])), known, ["x0"], 5).collect()
    assert sorted((r.neighbour, r.distance) for r in near) == [(0, 0.0), (1, 2.0)]
    assert neighbours.nearest_known(known, known.where("user_id < 0"), ["x0"], 5).count() == 0


def test_new_rows_lie_by_their_neighbours(spark, curved):
    known = durable(frame(spark, curved))
    found = spark.createDataFrame([(i, float(i // 60), 1.0) for i in range(360)], "user_id long, ly1 double, ly2 double")
    placed = layout.place(frame(spark, curved + 1e-6, 1000), known, found, NAMES, 5).collect()
    assert len(placed) == 360
    assert all(r.ly2 == pytest.approx(1.0) and -1e-9 <= r.ly1 <= 5 + 1e-9 for r in placed)
    near = np.array([r.ly1 for r in sorted(placed, key=lambda r: r.user_id)])
    assert np.mean(np.abs(near - np.arange(360) // 60) < 0.5) > 0.9


def test_bootstrap_band_is_near_the_closed_one(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(v)) for g, (n, p) in enumerate([(2000, 0.3), (900, 0.8), (400, 0.5)], 1) for v in rng.random(n) < p]
    df = spark.createDataFrame(rows + [(None, 1), (1, None)], "g int, v int")
    found = {r.g: r for r in explore.bootstrap_means(df, "g", "v").collect()}
    for g in (1, 2, 3):
        values = np.array([v for k, v in rows if k == g])
        half = 1.96 * values.std() / np.sqrt(len(values))
        r = found[g]
        assert (r.n, r.mean) == (len(values), pytest.approx(values.mean()))
        assert r.band_low == pytest.approx(values.mean() - half, abs=0.25 * half)
        assert r.band_high == pytest.approx(values.mean() + half, abs=0.25 * half)
        # rows drawn with replacement, one by one
        drawn = rng.choice(values, (1000, len(values))).mean(axis=1)
        low, high = np.percentile(drawn, [2.5, 97.5])
        assert (r.band_low, r.band_high) == (pytest.approx(low, abs=0.25 * half), pytest.approx(high, abs=0.25 * half))
    again = {r.g: r for r in explore.bootstrap_means(df.repartition(5), "g", "v").collect()}
    assert again == found


def test_bootstrap_of_equal_and_of_no_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (2, 3.0)], "g int, v double")
    assert sorted(map(tuple, explore.bootstrap_means(df, "g", "v").collect())) == [(1, 1, 1.0, 1.0, 1.0), (2, 2, 3.0, 3.0, 3.0)]
    assert explore.bootstrap_means(df.where(F.col("g") > 5), "g", "v").count() == 0


def test_packed_hash_is_the_table_hash(spark):
    """Draws over packed edges are those of the columns' own hash."""
    from basketlens.operators.blocks import hash_of

    rng = np.random.default_rng(3)
    i, j = rng.integers(-(1 << 62), 1 << 62, (2, 50))
    rows = spark.createDataFrame([(n, int(a), int(b)) for n, (a, b) in enumerate(zip(i, j))], "n long, i long, j long")
    found = rows.select(F.xxhash64("i", "j", F.lit(-7))).orderBy("n").collect()
    assert hash_of(np.int32(-7), hash_of(j, hash_of(i))).astype(np.int64).tolist() == [r[0] for r in found]


def test_packed_epochs_are_the_joined_ones(spark, curved, monkeypatch):
    """Blocks that exchange spots and pushes move points as joins of all edges do."""
    near = neighbours.nearest_neighbours(frame(spark, curved), NAMES)
    edges = near.select(F.col("user_id").alias("i"), F.col("neighbour").alias("j"), F.round("weight", 9).alias("weight"))
    graph = durable(neighbours.fuzzy_union(edges).where("i <> 17 AND j <> 17"))
    start = durable(frame(spark, curved).select(F.col("user_id").alias("i"), F.array("x0", "x1", "x2").alias("spots")))
    joined, again = [layout.laid_out(graph, start, 3, epochs=4, crowd_rows=50).orderBy("i").collect() for _ in range(2)]
    assert joined == again
    joins, pulls = [], layout._pulls
    monkeypatch.setattr(layout, "PACKED_POINTS", 1)
    monkeypatch.setattr(layout, "BLOCK_POINTS", 40)
    monkeypatch.setattr(layout, "_pulls", lambda *a: joins.append(1) or pulls(*a))
    packed = layout.laid_out(graph, start, 3, epochs=4, crowd_rows=50).orderBy("i").collect()
    assert not joins and [r.i for r in packed] == [r.i for r in joined]
    assert np.abs(np.array([r.spots for r in packed]) - np.array([r.spots for r in joined])).max() < 1e-7
