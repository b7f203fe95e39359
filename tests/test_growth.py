"""Figures that must not grow with the tables beyond what a task or a number holds."""

from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens import session
from basketlens.operators import boosting, fuzzy, layout, neighbours, validity, ward
from basketlens.operators.blocks import packed_blocks
from basketlens.plans import segmentation
from basketlens.sources import retail as retail_source
from basketlens.sources.retail import RetailTables
from tests.conftest import SMALL


def test_sums_of_many_rows(spark):
    """Weights that add up to more than a long holds in the finest unit."""
    rows = spark.range(60_000).select(
        F.array(F.lit(0)).alias("bins"), F.lit(0).alias("y"), F.lit(3.0).alias("w"), F.lit(0.0).alias("margin")
    )
    unit = boosting.unit_of(180_000.0)
    (found,) = boosting.histogram(boosting.packed(rows), boosting.Tree(), [1], unit).collect()
    assert found.g * unit == pytest.approx(90_000.0) and found.h * unit == pytest.approx(45_000.0)


def test_lines_are_numbered_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(retail_source, "TASK_LINES", 500)
    tables = RetailTables(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert tables._placed_lines.rdd.getNumPartitions() >= lines // 500


def test_last_lines_take_no_sorted_struct(spark, retail):
    plan = retail.order_products_train._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_spectral_over_several_blocks(spark, monkeypatch):
    """A chain cut into many blocks: the products' exchange joins all of them, and a
    round of the space starts few jobs."""
    monkeypatch.setattr(neighbours, "GRAPH_ROWS", 8)
    n = 40
    ends = [(i, i + 1) for i in range(n - 1)] + [(0, 5), (17, 30)]
    graph = spark.createDataFrame([(a, b, 1.0 + a % 3) for a, b in ends] + [(b, a, 1.0 + a % 3) for a, b in ends], "i long, j long, weight double")
    found = neighbours.spectral(graph, 3, residual=1e-6).orderBy("i").collect()
    dense = np.zeros((n, n))
    for a, b in ends:
        dense[a, b] = dense[b, a] = 1.0 + a % 3
    root = np.sqrt(dense.sum(axis=1))
    vectors = np.linalg.eigh(dense / root[:, None] / root[None, :])[1][:, ::-1][:, 1:4]
    spots = np.array([r.spots for r in found])
    assert np.abs(np.abs(spots.T @ vectors) - np.eye(3)).max() < 1e-4


def test_spectral_writes_the_space_once_a_product(spark, monkeypatch):
    """Making a product orthonormal does not write basis and image again."""
    written, products, whole, multiplied = [], [], neighbours.durable, neighbours._multiplied
    monkeypatch.setattr(neighbours, "durable", lambda df: written.append("basis" in df.columns) or whole(df))
    monkeypatch.setattr(neighbours, "_multiplied", lambda *a: products.append(1) or multiplied(*a))
    ends = [(i, i + 1) for i in range(11)] + [(0, 5), (3, 9)]
    graph = spark.createDataFrame([(a, b, 1.0 + a % 3) for a, b in ends] + [(b, a, 1.0 + a % 3) for a, b in ends], "i long, j long, weight double")
    neighbours.spectral(graph, 2)
    # the first state and the last one are written too
    assert sum(written) == len(products) + 2


def test_answers_keep_small_distances(spark):
    """Rows far from the origin and close to each other: distances keep their digits."""
    import pandas as pd

    x = np.random.default_rng(6).normal(size=(300, 2)) * 1e-6 + [1e3, -2e3]
    rows = pd.DataFrame({"user_id": np.arange(300), "x": x[:, 0], "y": x[:, 1], "bound": np.inf})
    near = neighbours._nearest_of(rows, rows, ["x", "y"], "user_id", 3, True)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    assert near["neighbour"].to_numpy().reshape(-1, 3).tolist() == np.argsort(apart, axis=1, kind="stable")[:, :3].tolist()
    assert near["distance"].to_numpy().reshape(-1, 3).tolist() == np.sort(apart, axis=1)[:, :3].tolist()


def test_answers_stop_at_the_bound(spark):
    """Blocks do not answer with rows beyond what the asking row's own block has."""
    import pandas as pd

    asking = pd.DataFrame({"user_id": [1, 2], "x": [0.0, 5.0], "bound": [1.0, 2.0]})
    known = pd.DataFrame({"user_id": [1, 3, 4, 5, 6], "x": [0.0, 1.0, -1.0, 6.0, 9.0]})
    near = neighbours._nearest_of(asking, known, ["x"], "user_id", 2, True)
    assert near.values.tolist() == [[1, 3, 1.0], [1, 4, 1.0], [2, 5, 1.0]]


def test_rows_ask_few_blocks(spark, monkeypatch):
    """Blocks are parts of the space: a row asks the few whose boxes come near it, and many
    equal rows find those of the lowest keys without asking any other block."""
    asked, whole = [], neighbours.durable

    def counted(df):
        table = whole(df)
        if "asked" in table.columns:
            asked.append(table.selectExpr("avg(size(asked))").first()[0])
        return table

    monkeypatch.setattr(neighbours, "durable", counted)
    x = np.vstack([np.random.default_rng(9).random((1500, 2)), np.full((500, 2), 3.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_id long, x double, y double")
    near = neighbours.nearest_neighbours(df, ["x", "y"], 3, cells=64, block_rows=64).toPandas()
    assert len(asked) == 1 and asked[0] < 4
    found = near.sort_values(["user_id", "distance", "neighbour"])["neighbour"].to_numpy().reshape(-1, 3)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert found.tolist() == np.argsort(apart, axis=1, kind="stable")[:, :3].tolist()


def test_silhouette_over_blocks(spark):
    """Small distances beside far rows keep their digits; equal rows are at distance 0."""
    rng = np.random.default_rng(5)
    spots = np.vstack([rng.normal(0, 1e-3, (30, 2)), rng.normal(4, 1, (30, 2)), [[900.0, -700.0]] * 3])
    labels = np.arange(63) % 2
    rows = [(i, int(labels[i]), *map(float, spots[i])) for i in range(63)]
    df = spark.createDataFrame(rows, "user_id long, cluster int, x double, y double")
    found = {r.user_id: r.silhouette for r in validity.silhouette_values(df, ["x", "y"], key="user_id").toDF("user_id", *["labeling", "silhouette"]).collect()}
    apart = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(axis=2))
    assert np.abs(validity._totals(spots, spots, np.eye(63)) - apart).max() < 1e-9
    for i in range(63):
        a = apart[i, labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1)
        b = apart[i, labels != labels[i]].mean()
        assert found[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_blocks_of_a_silhouette_meet_once(spark, monkeypatch):
    """A pair of blocks is compared once for both its sides, packed in a row each; rows
    without a label get no silhouette and are in no other's."""
    rng, pairs, whole = np.random.default_rng(8), [], validity.durable
    x, labels = rng.normal(size=(60, 2)), [None if i % 9 == 4 else i % 3 for i in range(60)]
    monkeypatch.setattr(validity, "durable", lambda df: [t := whole(df), pairs.append(t.count())][0])
    df = spark.createDataFrame([(i, labels[i], *map(float, r)) for i, r in enumerate(x)], "user_id long, cluster int, x double, y double")
    found = {r.user_id: r.silhouette for r in validity.silhouette_values(df, ["x", "y"], block_rows=12).collect()}
    assert pairs == [5 * 5]
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(60):
        inside = {c: [apart[i, j] for j in range(60) if labels[j] == c and j != i] for c in range(3)}
        if labels[i] is None:
            assert found[i] is None
            continue
        a, b = np.mean(inside.pop(labels[i])), min(map(np.mean, inside.values()))
        assert found[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_fuzzy_sums_do_not_depend_on_partitions(blobs):
    """Sums of packed blocks are whole numbers: fits agree bit by bit."""
    fits = [fuzzy.fuzzy_cmeans(df, ["x", "y"], [2, 3]) for df in (blobs, blobs.repartition(5))]
    for c in (2, 3):
        assert fits[0][c].centres.tolist() == fits[1][c].centres.tolist()
        assert fits[0][c].objectives == fits[1][c].objectives


def test_fuzzy_passes_settle_as_the_whole_change_does(spark):
    """A task may stop adding up a change once it is too large; one below the limit is
    exact, and small distances keep their digits."""
    x = np.random.default_rng(2).normal(size=(500, 3)) + 50.0
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    blocks = packed_blocks(spark.createDataFrame(rows, "user_id long, a double, b double, c double"), ["a", "b", "c"], "user_id", 64)
    centres, before = {2: x[:2] + 1e-7}, {2: x[:2] + 2e-7}
    whole = fuzzy._sums(x, centres, before, 2.0)[2]
    rows, found = fuzzy._block_pass(blocks, 3, centres, before, 2.0, 1.0)
    assert rows == 500 and found[2] == pytest.approx(whole, rel=1e-9)
    _, cut = fuzzy._block_pass(blocks, 3, centres, {2: x[:2] + 1.0}, 2.0, 1e-3)
    assert 1e-6 < cut[2][:, 3].sum() <= fuzzy._sums(x, centres, {2: x[:2] + 1.0}, 2.0)[2][:, 3].sum() * (1 + 1e-9)
    direct = ((x[:, None] - centres[2][None]) ** 2).sum(axis=2).T
    assert fuzzy._distances(x, centres[2]) == pytest.approx(direct, rel=1e-9)


def test_memberships_are_worked_out_once(spark):
    """Elements of an array share what they need: distances, the least of them and the sum
    appear once in the plan, not once more for every element that reads them."""
    from basketlens.functions.scalars import argmax_label

    centres = np.array([[0.0, 0.0], [3.0, 1.0], [1.0, 4.0]])
    model = fuzzy.FuzzyModel(("x", "y"), centres, 2.0, (), 0.5, True)
    x = np.vstack([np.random.default_rng(5).normal(1.0, 2.0, (40, 2)), centres[1:2], [[1.5, 0.5]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double")
    label = df.select("*", argmax_label(model.memberships()).alias("label"))
    plan = label._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_min(") == 1 and plan.count("aggregate(") == 1
    apart = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert [r.label for r in label.collect()] == apart.argmin(axis=1).tolist()
    close = np.where(apart == 0.0, 1e30, 1.0 / np.maximum(apart, 1e-30))
    found = np.array([r[0] for r in df.select(model.memberships()).collect()])
    assert found == pytest.approx(close / close.sum(axis=1, keepdims=True), abs=1e-12)


def test_pulls_are_summed_without_decimals(spark):
    """Rounding a double half up builds a decimal per edge and axis; rint does not."""
    state = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.5])], "i long, spots array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, weight double")
    pulls = layout._pulls(state, edges, 0, 2, 42)
    plan = pulls._jdf.queryExecution().optimizedPlan().toString()
    assert "rint(" in plan.lower() and "round(" not in plan.lower()
    rows = {r.i: r for r in pulls.collect()}
    assert rows[0].pulled == [-v for v in rows[1].pulled] and rows[0].pulled[0] > 0
    x = np.array([[0.0, 0.0], [1.0, 0.5], [-2.0, 1.0]])
    gaps = x[:, None] - x[None]
    far = (gaps**2).sum(axis=2)
    size = 2 * layout.CURVE_B / ((0.001 + far) * (1 + layout.CURVE_A * far**layout.CURVE_B))
    direct = np.clip(size[:, :, None] * gaps, -layout.LARGEST_PUSH, layout.LARGEST_PUSH).sum(axis=1) / 2
    assert layout._crowd_push(x) == pytest.approx(direct, rel=1e-12)


def test_boosting_keeps_few_trees_out_of_the_margins(spark, monkeypatch):
    """A level's pass walks few unwritten trees, and margins written over are deleted."""
    seen, whole = [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda *a: seen.append((len(a[4]), len(session._written))) or whole(*a))
    rows = spark.range(400).select((F.col("id") % 37).alias("x"), F.sin("id").alias("z"), (F.sin(F.col("id") * 3) > 0).cast("int").alias("y"), F.lit(1.0).alias("w"))
    model = boosting.fit(rows, ["x", "z"], "y", "w", trees=8, depth=2)
    assert len(model.trees) == 8
    assert max(new for new, _ in seen) <= 2
    assert len({written for _, written in seen}) == 1


def test_ward_partners_are_sought_in_many_tasks(spark, monkeypatch):
    """Blocks are little data but much work: their parts are not put together by size."""
    tables, whole = [], ward.durable
    monkeypatch.setattr(ward, "durable", lambda df: tables.append(whole(df)) or tables[-1])
    monkeypatch.setattr(ward, "discard", lambda *found: None)
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(700, 3)) + 30.0, np.exp2(rng.integers(0, 9, 700)).astype(float)
    rows = [(i, float(n[i]), *map(float, x[i])) for i in range(700)]
    points = spark.createDataFrame(rows, "id long, n double, x0 double, x1 double, x2 double")
    found = ward.nearest_partners(points, 3, block_rows=16).orderBy("id").collect()
    cost = ((x[:, None] - x[None]) ** 2).sum(axis=2) * (n[:, None] * n / (n[:, None] + n))
    np.fill_diagonal(cost, np.inf)
    assert [r.near for r in found] == cost.argmin(axis=1).tolist()
    assert [r.cost for r in found] == pytest.approx(cost.min(axis=1).tolist(), rel=1e-12)
    assert tables[0].selectExpr("block >> 32").distinct().count() == 8


@pytest.mark.parametrize("sample_size", [None, 60])
def test_all_counts_are_scored_in_shared_passes(spark, monkeypatch, sample_size):
    """The tables written do not follow the number of clusterings; the indices are those
    of each clustering alone."""
    written, whole = [], validity.durable
    monkeypatch.setattr(validity, "durable", lambda df: written.append(1) or whole(df))
    rng = np.random.default_rng(8)
    spots, labels = rng.normal(size=(90, 2)), rng.integers(0, 5, (90, 4))
    labels[:, 1] = labels[:, 0] % 2
    rows = [(i, *map(float, spots[i]), *map(int, labels[i])) for i in range(90)]
    df = whole(spark.createDataFrame(rows, "user_id long, x double, y double, " + ", ".join(f"c{k} int" for k in range(4))))
    counts = []
    for ks in (range(2), range(4)):
        written.clear()
        found = {r.k: r for r in validity.metric_table(df, ["x", "y"], "m", {k: f"c{k}" for k in ks}, sample_size).collect()}
        counts.append(len(written))
    assert counts[0] == counts[1] and sorted(found) == [0, 1, 2, 3]
    for k in range(4):
        alone = df.withColumn("cluster", F.col(f"c{k}"))
        silhouette = (
            validity.silhouette_sq(alone, ["x", "y"]) if sample_size is None else validity.silhouette(alone, ["x", "y"], sample_size=sample_size)
        )
        expected = [silhouette, validity.calinski_harabasz(alone, ["x", "y"]), validity.davies_bouldin(alone, ["x", "y"])]
        assert list(found[k])[2:] == pytest.approx([e.first()[0] for e in expected], rel=1e-9)


def test_clusterings_without_rows_are_no_score(spark):
    rows = spark.createDataFrame([(1, 0.5, 0, None), (2, 1.5, 1, None)], "user_id long, x double, c2 int, c3 int")
    for df, labels in ((rows, {2: "c2", 3: "c3"}), (rows.limit(0), {2: "c2"})):
        with pytest.raises(ValueError, match="labelled row"):
            validity.metric_table(df, ["x"], "m", labels)


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    """A sweep that waits for another one to be under way gets there."""
    together = Barrier(2, timeout=60)
    rows = spark.range(4).withColumnRenamed("id", "user_id")

    def sweep(rep, ks):
        together.wait()
        return spark.createDataFrame(
            [(k, k / 10, k / 1.0, 1.0 / k) for k in ks], "k int, silhouette double, calinski_harabasz double, davies_bouldin double"
        )

    for name in ("kmeans", "fuzzy", "ward", "gmm"):
        monkeypatch.setattr(segmentation, f"{name}_sweep", sweep)
    reps = {name: segmentation.Representation(name, rows, ()) for name in ("raw", "PCA")}
    found = segmentation.rank_models(reps, ks=(2, 3)).collect()
    methods = [f"{m} {rep}" for m in ("fuzzy_cmeans", "gmm", "kmeans", "ward") for rep in ("PCA", "raw")]
    assert [(r.method, r.k) for r in found] == [(m, k) for k in (3, 2) for m in methods]
