"""The plans for oversized keys give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import ranking
from basketlens.sources.retail import RetailTables
from tests.conftest import SMALL


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def split(spark):
    return RetailTables(spark, SMALL, hot_rows=5)


def test_hot_keys_are_found(split):
    counted = split.placed.groupBy("user_id").count().where("count > 5")
    found = [r["user_id"] for r in split._hot_users.collect()]
    assert found and sorted(found) == sorted(r["user_id"] for r in counted.collect())


def test_no_probe_of_small_tables(retail):
    assert retail._hot_users is None


def key_rows(df):
    return sorted(((r["order_id"], r) for r in df.collect()), key=lambda p: p[0])


def test_orders_of_hot_users(split, retail):
    columns = retail.orders.columns
    assert key_rows(split.orders.select(columns)) == key_rows(retail.orders.select(columns))


def test_lines_of_hot_orders_and_users(split, retail):
    assert rows(split.lines) == rows(retail.lines)


def test_lines_of_last_orders(split, retail):
    expected = rows(retail.lines.where("is_last").drop("is_last"))
    assert rows(retail.order_products_train) == expected
    assert rows(split.order_products_train) == expected


def test_hot_pairs(spark):
    """One user whose every order holds one product."""
    lines = spark.createDataFrame(
        [(i, 1, 7, i) for i in range(1, 30)] + [(i, 1, 100 + i, i) for i in range(1, 30)]
        + [(100, 2, 7, 1)],
        "order_id long, user_id long, product_id long, order_number int",
    )
    tables = RetailTables(spark, SMALL, hot_rows=5)
    tables.__dict__["_hot_users"] = spark.createDataFrame([(1,)], "user_id long")
    marked = {(r.user_id, r.order_id, r.product_id): r._first for r in tables._mark_reordered(lines).collect()}
    assert len(marked) == 59
    assert all(marked[1, i, 7] == 1 for i in range(1, 30))
    assert all(marked[1, i, 100 + i] == i for i in range(1, 30))
    assert marked[2, 100, 7] == 1


def test_sampled_probe_finds_a_dominant_key(spark):
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k")
    )
    assert [r["k"] for r in ranking.hot_keys(df, ["k"], 5_000).collect()] == [0]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_running_totals(spark, descending, buckets):
    rng = np.random.default_rng(5)
    values = sorted({float(v) for v in rng.integers(0, 500, 200)}, reverse=descending)
    weights = [int(w) for w in rng.integers(0, 9, len(values))]
    df = spark.createDataFrame(list(zip(values, weights)), "v double, w int")
    out = ranking.running_totals(
        df, "v", {"w": "upto"}, descending, following={"w": "next"}, buckets=buckets
    )
    found = {r.v: (r.upto, r.next) for r in out.collect()}
    totals = np.cumsum(weights)
    expected = {
        v: (int(totals[i]), weights[i + 1] if i + 1 < len(values) else None)
        for i, v in enumerate(values)
    }
    assert found == expected


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 5, 5], list(range(50)) + [7] * 31 + [90]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    row = ranking.quantiles(
        ranking.value_frequencies(df, "v"), {"a": 0.25, "b": 0.5, "c": 0.75, "d": 1.0}
    ).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75, 1.0])))


def test_ordinal_by_cells(spark):
    df = spark.createDataFrame(
        [(u, d, d // 3, d // 7) for u in (1, 2) for d in range(40) if d % (u + 1)],
        "u int, d int, fine int, coarse int",
    )
    out = ranking.ordinal_by_cells(df, ["u"], ["coarse", "fine"], ["d"], "n")
    for u in (1, 2):
        found = [r.n for r in out.where(F.col("u") == u).orderBy("d").collect()]
        assert found == list(range(1, len(found) + 1))
