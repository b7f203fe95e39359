"""Hand-made tables for missing values, ties and degenerate groups."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basketlens.operators import churn, explore, features, profiles, quality, relational, sampling
from basketlens.functions import scalars
from basketlens.sources.schemas import FEATURES, ORDERS, TABLES
from basketlens.sources import tables as io
from basketlens.operators import validity


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame(
        [
            (1, 10, "prior", 1, 0, 5, None),
            (2, 10, "train", 2, 3, 7, 30.0),
            (3, 11, "train", 1, 6, 23, None),
            (4, None, "train", 1, 6, 23, None),
        ],
        ORDERS,
    )
    lines = spark.createDataFrame(
        [(1, 100, 1, 0), (2, 100, 1, 1), (2, 999, 2, 0), (3, 101, 1, 0), (4, 100, 1, 0)],
        TABLES["order_products__train"][0],
    )
    products = spark.createDataFrame(
        [(100, "Organic Kale", 1, 1), (101, "organic rice", 9, 1), (102, None, 1, 2)],
        TABLES["products"][0],
    )
    aisles = spark.createDataFrame([(1, "greens"), (2, "grains")], TABLES["aisles"][0])
    departments = spark.createDataFrame([(1, "fresh"), (2, "dry")], TABLES["departments"][0])
    return io.ShopTables(orders, products, aisles, departments, lines, lines)


def test_all_missing_gaps_sum_to_zero(shop):
    days = {r.user_id: r.days_since_last_order for r in features.days_sum(shop.orders).collect()}
    assert days == {10: 30.0, 11: 0.0}


def test_features_fill_gaps_and_drop_missing_users(shop):
    found = {r.user_id: r for r in features.user_features(shop.orders, shop.order_products_train).collect()}
    assert set(found) == {10, 11}
    assert found[10].average_days_btw_orders == pytest.approx(20.0)
    assert found[10].unique_products == 2
    assert found[11].average_days_btw_orders == 0.0


def test_unknown_product_stays_in_left_joins_only(shop):
    left = relational.lines_products_left(shop.order_products_train, shop.products)
    assert left.count() == 5 and left.where("product_name IS NULL").count() == 1
    dim = relational.product_dim(shop.products, shop.aisles, shop.departments)
    assert {r.product_id for r in dim.collect()} == {100, 102}
    assert relational.lines_product_dim(shop.order_products_train, dim).count() == 3
    wide = relational.wide_table(
        shop.orders, shop.order_products_train, shop.products, shop.aisles, shop.departments
    )
    assert wide.count() == 5 and len(wide.columns) == 15
    assert wide.where("aisle IS NULL").count() == 2


def test_keyword_is_case_sensitive(shop):
    flags = {
        r.product_id: r.f
        for r in shop.products.select(
            "product_id", scalars.keyword_flag(F.col("product_name"), "Organic").alias("f")
        ).collect()
    }
    assert flags == {100: True, 101: False, 102: None}


def test_tie_at_rank_ten_goes_by_name(spark):
    products = spark.createDataFrame(
        [(i, f"p{i:02d}", 1, 1) for i in range(12)], TABLES["products"][0]
    )
    lines = spark.createDataFrame(
        [(i, i, 1, 0) for i in range(12)] + [(50, 11, 1, 0)], TABLES["order_products__train"][0]
    )
    top = [r.product_name for r in explore.top_products(lines, products).collect()]
    assert top == ["p11"] + [f"p{i:02d}" for i in range(9)]


def test_threshold_treats_missing_as_zero(spark):
    df = spark.createDataFrame([(21.0,), (20.0,), (None,)], "v double")
    assert [r[0] for r in df.select(scalars.threshold_label(F.col("v"), 20)).collect()] == [1, 0, 0]


def test_constant_feature_is_only_centred(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "user_id long, a double, b double")
    out = features.standardize(df, ["a", "b"]).orderBy("user_id").collect()
    assert [(r.a, r.b) for r in out] == [(0.0, -1.0), (0.0, 1.0)]


def test_scaler_uses_the_statistics_it_is_given(spark):
    train = spark.createDataFrame([(1, 0.0), (2, 4.0)], "user_id long, a double")
    test = spark.createDataFrame([(3, 6.0)], "user_id long, a double")
    scaled = features.apply_scaler(test, features.scaler_stats(train, ["a"]), ["a"])
    assert scaled.first().a == 2.0


def test_duplicates(spark):
    repeated = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    single = spark.createDataFrame([(1, 2)], "a int, b int")
    empty = single.where("a > 5")
    some = {r.table_name: (r.has_duplicates, r.answer) for r in quality.duplicate_check({"r": repeated, "s": single, "e": empty}).collect()}
    assert some == {"r": (True, "No"), "s": (False, "No"), "e": (False, "No")}
    every = quality.duplicate_check({"r": repeated, "q": repeated}).collect()
    assert {r.answer for r in every} == {"Yes"}


def test_strip_and_fill(spark):
    df = spark.createDataFrame([(1, None)], " a int, ` days_since_prior_order ` double".replace(" a", "` a`", 1))
    clean = quality.strip_columns(df)
    assert clean.columns == ["a", "days_since_prior_order"]
    assert one(quality.fill_nulls(clean)) == {"a": 1, "days_since_prior_order": 0.0}
    assert quality.fill_nulls(clean.select("a")).columns == ["a"]


def test_single_class_is_an_error(spark):
    df = spark.createDataFrame([(1,), (1,)], "churn int")
    with pytest.raises(PySparkException, match="both classes"):
        churn.class_balance(df).collect()


def test_cast_errors(spark):
    good = {f.name: "1" for f in ORDERS}
    for bad in ("x", None):
        df = spark.createDataFrame([good | {"user_id": bad}], ", ".join(f"{f.name} string" for f in ORDERS))
        with pytest.raises(PySparkException, match="orders.user_id"):
            io.cast_types(df, "orders").collect()
    missing_gap = spark.createDataFrame(
        [good | {"days_since_prior_order": None}], ", ".join(f"{f.name} string" for f in ORDERS)
    )
    row = io.cast_types(missing_gap, "orders").first()
    assert row.user_id == 1 and row.days_since_prior_order is None


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_round_trip(shop, spark, tmp_path, fmt):
    io.write_tables(shop, str(tmp_path / fmt), fmt)
    loaded = io.load_tables(spark, str(tmp_path / fmt), fmt)
    for name, df in shop.named().items():
        again = loaded.named()[name]
        assert again.dtypes == df.dtypes
        assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    raw = io.raw_orders(spark, str(tmp_path / fmt), fmt)
    assert raw.where("days_since_prior_order IS NULL").count() == 3


def test_csv_with_bad_number_fails(spark, tmp_path):
    folder = tmp_path / "aisles.csv"
    folder.mkdir()
    (folder / "part.csv").write_text("aisle_id,aisle\none,greens\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        io.load_table(spark, str(tmp_path), "aisles").collect()


@pytest.mark.parametrize("seed", range(4))
def test_histogram_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    data = [
        rng.integers(0, 31, 300).astype(float),
        rng.normal(size=200),
        np.array([4.0, 4.0]),
        np.linspace(0.1, 0.7, 61),
    ][seed]
    bins = [30, 25, 10, 6][seed]
    counts, edges = np.histogram(data, bins=bins)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    out = explore.equal_width_histogram(df, "v", bins).orderBy("bin").collect()
    assert [r.n for r in out] == counts.tolist()
    assert [r.bin_left for r in out] + [out[-1].bin_right] == pytest.approx(edges.tolist())


DESCRIBED = {
    "Consistent customers": {},
    "High-engagement shoppers": {"total_max_orders": 20.0, "average_days_btw_orders": 5.0},
    "Retention customers": {"reorder_mean": 20.0},
    "Variety seekers": {"unique_products": 20.0, "reorder_mean": 5.0},
    "Unstable shoppers": {"average_hour_of_day": 20.0},
    "High-engagement shoppers, Retention customers": {
        "total_max_orders": 20.0, "average_days_btw_orders": 5.0, "reorder_mean": 20.0,
    },
}


@pytest.mark.parametrize("text", DESCRIBED)
def test_descriptions(spark, text):
    row = {c: 10.0 for c in FEATURES} | DESCRIBED[text] | {f"overall_{c}": 10.0 for c in FEATURES}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    assert df.select(profiles.classify_cluster()).first()[0] == text


def test_negative_mean_is_never_within(spark):
    df = spark.createDataFrame([(-1.0, -1.0)], "v double, m double")
    assert df.select(scalars.within_pct([F.col("v")], [F.col("m")], 0.05)).first()[0] is False


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.125,)], "v double")
    assert [r[0] for r in df.select(scalars.round_half_even(F.col("v"), 0)).collect()] == [0, 2, 2, 0, 0]
    assert df.select(scalars.round_half_even(F.col("v"), 2)).collect()[4][0] == 0.12


def test_sampling_ignores_partitioning(spark):
    df = spark.range(0, 500).select(F.col("id").alias("user_id"), (F.col("id") % 5).alias("g"))
    a = {r.user_id for r in sampling.sample_n(df, 60).collect()}
    b = {r.user_id for r in sampling.sample_n(df.repartition(13, "g"), 60).collect()}
    assert a == b and len(a) == 60
    assert a != {r.user_id for r in sampling.sample_n(df, 60, seed=7).collect()}
    assert sampling.sample_n(df, 9999).count() == 500


def test_samples_of_every_size(spark):
    df = spark.range(0, 500).select(F.col("id").alias("user_id"))
    ordered = [r.user_id for r in df.orderBy(scalars.sample_key(F.col("user_id"), sampling.SEED)).collect()]
    for n in (0, 1, 333, 500, 501):
        assert {r.user_id for r in sampling.sample_n(df, n).collect()} == set(ordered[:n])


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact(spark, digits):
    df = spark.range(0, 1000).select(
        F.col("id").alias("user_id"), (F.col("id") % 10 == 0).cast("int").alias("churn")
    )
    out = sampling.stratified_split(df, "churn", digits=digits)
    counts = {(r.churn, r.is_test): r["count"] for r in out.groupBy("churn", "is_test").count().collect()}
    assert counts == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = sampling.stratified_split(df.repartition(7), "churn", digits=digits)
    assert {r.user_id for r in out.where("is_test").collect()} == {
        r.user_id for r in again.where("is_test").collect()
    }


def test_singleton_cluster_has_zero_silhouette(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.0), (2, 0, 1.0), (3, 1, 10.0)], "user_id long, cluster int, x double"
    )
    values = {r.user_id: r.silhouette for r in validity.silhouette_values(df, ["x"]).collect()}
    assert values[3] == 0.0
    assert values[1] == pytest.approx(0.9) and values[2] == pytest.approx(8 / 9)
    assert validity.silhouette_sq(df, ["x"]).first()[0] == pytest.approx(((100 - 1) / 100 + (81 - 1) / 81) / 3)


def test_silhouette_limits(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0)], "user_id long, cluster int, x double")
    with pytest.raises(ValueError):
        validity.silhouette(df, ["x"])


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(70, 2)), rng.integers(0, 3, 70)
    df = spark.createDataFrame(
        [(i, int(c), *map(float, p)) for i, (c, p) in enumerate(zip(labels, x))], "user_id long, cluster int, x double, y double"
    )
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    expected = {}
    for i in range(70):
        means = {c: d[i, labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in range(3)}
        a = means.pop(labels[i])
        expected[i] = (min(means.values()) - a) / max(a, min(means.values()))
    for size in (16, 4096):
        values = validity.silhouette_values(df, ["x", "y"], block_rows=size).collect()
        assert {r.user_id: r.silhouette for r in values} == pytest.approx(expected)
    part = validity.silhouette(df, ["x", "y"], sample_size=40).first()[0]
    assert part == pytest.approx(validity.silhouette(sampling.sample_n(df, 40), ["x", "y"]).first()[0])


def test_best_model(spark):
    df = spark.createDataFrame(
        [("a", 2, 0.5, 100.0, 0.5), ("b", 2, 0.4, 90.0, 0.9), ("b", 3, 0.4, 120.0, 1.0)],
        "method string, k int, silhouette double, calinski_harabasz double, davies_bouldin double",
    )
    ranked = validity.best_model(df).collect()
    assert (ranked[0].method, ranked[0].k) == ("a", 2)
    assert ranked[0].mean_rank == pytest.approx(4 / 3)
    assert [r.silhouette_rank for r in ranked if r.method == "b"] == [2, 2]


def test_written_tables_can_be_removed(spark):
    from basketlens import session

    kept = list(session._written)
    session._written.clear()
    table = session.durable(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    assert session.clean_up(spark) == 1 and not os.path.exists(path)
    session._written.extend(kept)
