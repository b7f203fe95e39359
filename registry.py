"""The registered queries: each takes (spark, directory) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import astuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketlens.functions import scalars
from basketlens.operators import (
    boosting,
    churn,
    explore,
    features,
    fuzzy,
    lloyd,
    mixture,
    layout,
    neighbours,
    partition,
    profiles,
    quality,
    reduce as reduce_ops,
    relational,
    sampling,
    scoring,
    validity,
    ward as ward_ops,
)
from basketlens.operators import autoencoder as autoencoder_ops
from basketlens.operators.blocks import packed_blocks
from basketlens.operators.autoencoder import autoencode as encode, train_autoencoder
from basketlens.plans import churn as churn_plan, segmentation
from basketlens.session import durable, durable_folder
from basketlens.sources import tables as table_io
from basketlens.sources.retail import RetailTables
from basketlens.sources.schemas import FEATURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The driver's parts hold no "Organic" name and its users order far apart, so
# these two parameters differ from the defaults.
KEYWORD = "red"
CHURN_DAYS = 240


def query(fn):
    """Register ``fn(tables)`` under its own name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return fn(RetailTables(spark, directory))

    QUERIES[fn.__name__] = run
    return fn


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns to six places, as the SQL side does."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


MEANS = tuple(c for c in FEATURES if c not in ("total_max_orders", "unique_products"))


def train_features(t: RetailTables) -> DataFrame:
    return features.user_features(t.orders, t.order_products_train)


def scaled_users(t: RetailTables) -> DataFrame:
    return features.standardize(durable(train_features(t)))


# -- sources and quality ---------------------------------------------------------


@query
def load_tables(t):
    eval_set = F.when(F.col("is_last"), "train").otherwise("prior").alias("eval_set")
    return t.lines.select("order_id", "product_id", "add_to_cart_order", "reordered", eval_set)


@query
def load_delimited(t):
    """All six tables written as delimited files, loaded again; the basket lines."""
    folder = f"{durable_folder(t.spark)}/shop-{uuid.uuid4().hex}"
    table_io.write_tables(t.tables(), folder, "csv")
    shop = table_io.load_tables(t.spark, folder, "csv")
    lines = shop.order_products_prior.withColumn("eval_set", F.lit("prior")).unionByName(
        shop.order_products_train.withColumn("eval_set", F.lit("train"))
    )
    named = lines.join(shop.orders.select("order_id", "order_dow"), "order_id").join(
        shop.products.select("product_id", "aisle_id"), "product_id"
    )
    return named.join(shop.aisles, "aisle_id").select(
        "order_id", "product_id", "add_to_cart_order", "reordered", "eval_set", "order_dow", "aisle"
    )


@query
def raw_orders(t):
    return t.orders


@query
def row_count(t):
    return quality.row_count(t.placed)


@query
def table_overview(t):
    every = t.tables().named()
    every["wide_table"] = relational.wide_table(
        t.orders, t.order_products_train, t.products, t.aisles, t.departments
    )
    return quality.table_overview(every)


@query
def preview(t):
    wide = relational.wide_table(
        quality.fill_nulls(t.orders), t.order_products_train, t.products, t.aisles, t.departments
    )
    columns = (
        "user_id", "order_id", "order_number", "order_dow", "order_hour_of_day",
        "days_since_prior_order", "product_id", "add_to_cart_order", "reordered",
        "department", "aisle",
    )
    return quality.preview(wide, ("order_id", "product_id"), columns)


@query
def strip_columns(t):
    spaced = t.orders.select("order_id", "user_id", "order_number").toDF(
        " order_id", "user_id ", " order_number "
    )
    return quality.strip_columns(spaced)


@query
def null_counts(t):
    return quality.null_counts(t.orders)


@query
def missing_report(t):
    return quality.missing_report(t.tables().named())


@query
def fill_nulls(t):
    return quality.fill_nulls(t.orders).select("order_id", "days_since_prior_order")


@query
def duplicate_check(t):
    return quality.duplicate_check(t.tables().named())


@query
def duplicate_rows_lines(t):
    pairs = t.spark.read.parquet(f"{t.directory}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber"
    )
    return quality.duplicate_check({"order_parts": pairs})


@query
def cast_types(t):
    text = t.orders.select([F.col(c).cast("string").alias(c) for c in t.orders.columns])
    return table_io.cast_types(text, "orders")


@query
def project(t):
    return six(relational.project(train_features(t), FEATURES), *MEANS)


@query
def rename(t):
    renamed = relational.rename(
        t.order_products_train, {"order_id": "basket", "product_id": "item"}
    )
    return renamed.select("basket", "item")


@query
def keyword_flag(t):
    return t.products.select(
        "product_id",
        "product_name",
        scalars.keyword_flag(F.col("product_name"), KEYWORD).alias("is_match"),
    )


@query
def drop_null_rows(t):
    return quality.drop_null_rows(t.orders, ["days_since_prior_order"])


@query
def row_filter(t):
    sundays = relational.rows_of(t.placed, "order_dow", 0)
    return relational.rows_with_keys(t.orders, sundays, "user_id")


@query
def threshold_label(t):
    return t.orders.select(
        "order_id", scalars.threshold_label(F.col("days_since_prior_order"), 20).alias("label")
    )


@query
def subtract_row(t):
    users = durable(train_features(t))
    means = users.agg(*[F.avg(c).alias(c) for c in FEATURES])
    return six(relational.subtract_row(users, means, FEATURES), *FEATURES)


# -- joins -------------------------------------------------------------------------


@query
def lines_products_left(t):
    return relational.lines_products_left(t.order_products_train, t.products)


@query
def product_dim(t):
    return relational.product_dim(t.products, t.aisles, t.departments)


@query
def lines_product_dim(t):
    dim = relational.product_dim(t.products, t.aisles, t.departments)
    return relational.lines_product_dim(t.order_products_train, dim)


@query
def orders_lines(t):
    return relational.orders_lines(quality.fill_nulls(t.orders), t.order_products_train)


@query
def wide_table(t):
    return relational.wide_table(
        quality.fill_nulls(t.orders), t.order_products_train, t.products, t.aisles, t.departments
    )


@query
def features_churn(t):
    return six(relational.features_churn(train_features(t), features.days_sum(t.orders)), *MEANS)


# -- aggregates ----------------------------------------------------------------------


@query
def orders_per_user(t):
    return explore.orders_per_user(t.orders)


@query
def orders_per_user_hist(t):
    return six(explore.orders_per_user_hist(t.orders), "bin_left", "bin_right")


@query
def gap_hist(t):
    return six(explore.gap_hist(quality.fill_nulls(t.orders)), "bin_left", "bin_right")


@query
def orders_by_hour(t):
    return explore.orders_by_hour(t.placed)


@query
def orders_by_dow(t):
    return explore.orders_by_dow(t.placed)


@query
def distinct_values(t):
    return explore.distinct_values(t.placed)


@query
def describe(t):
    return six(explore.describe(t.orders, "order_number"), "mean", "std")


@query
def outlier_stats(t):
    return explore.outlier_stats(t.orders, "order_number")


@query
def reorder_by_cart_pos(t):
    return six(
        explore.reorder_by_cart_pos(t.order_products_train), "reorder_mean", "band_low", "band_high"
    )


@query
def reorder_bootstrap(t):
    """The same means with the band of 1,000 bootstrap resamples."""
    means = explore.bootstrap_means(t.order_products_train, "add_to_cart_order", "reordered")
    return six(means, "mean", "band_low", "band_high")


@query
def reorder_rate(t):
    return six(explore.reorder_rate(t.order_products_train), "reorder_rate")


@query
def value_counts(t):
    dim = relational.product_dim(t.products, t.aisles, t.departments)
    return explore.value_counts(
        relational.lines_product_dim(t.order_products_train, dim), "department"
    )


@query
def organic_share(t):
    dim = relational.product_dim(t.products, t.aisles, t.departments)
    return six(explore.organic_share(t.order_products_train, dim, KEYWORD), "percent")


@query
def user_features(t):
    return six(train_features(t), *MEANS)


@query
def user_features_all_lines(t):
    return six(features.user_features(t.orders, t.lines.drop("is_last")), *MEANS)


@query
def days_sum(t):
    return features.days_sum(t.orders)


@query
def top_products(t):
    return explore.top_products(t.order_products_train, t.products)


@query
def top_departments(t):
    dim = relational.product_dim(t.products, t.aisles, t.departments)
    return explore.top_departments(t.order_products_train, dim)


@query
def top_aisles(t):
    dim = relational.product_dim(t.products, t.aisles, t.departments)
    return explore.top_aisles(t.order_products_train, dim)


# -- scalars -----------------------------------------------------------------------------


@query
def round_half_even(t):
    orders = t.spark.read.parquet(f"{t.directory}/orders.parquet")
    return orders.select(
        "o_orderkey",
        scalars.round_half_even(F.col("o_totalprice") / 7, 2).alias("rounded"),
        scalars.round_half_even(F.col("o_orderkey") + F.lit(0.5), 0).alias("half_rounded"),
    )


@query
def percent_text(t):
    orders = t.spark.read.parquet(f"{t.directory}/orders.parquet")
    return orders.select(
        "o_orderkey", scalars.percent_text((F.col("o_orderkey") % 1000) / 1000.0).alias("text")
    )


@query
def argmax_label(t):
    scaled = six(features.standardize(durable(train_features(t))), *FEATURES)
    return scaled.select("user_id", scalars.argmax_label(F.array(*FEATURES)).alias("label"))


@query
def within_pct(t):
    users = durable(train_features(t))
    checked = ("average_hour_of_day", "unique_products")
    means = users.agg(F.struct(*[F.avg(c).alias(c) for c in checked]).alias("m")).scalar()
    flag = scalars.within_pct(
        [F.col(c) for c in checked], [F.col(f"_m.{c}") for c in checked], 0.5
    )
    return users.withColumn("_m", means).select("user_id", flag.alias("is_within"))


@query
def join_labels(t):
    labels = [
        (F.col("order_dow").isin(0, 6), "weekend"),
        (F.col("order_hour_of_day") < 6, "night"),
        (F.col("order_number") == 1, "first"),
    ]
    return t.orders.select("order_id", scalars.join_labels(labels, "regular").alias("labels"))


# -- sampling and scaling -------------------------------------------------------------------


@query
def sample_n(t):
    return six(sampling.sample_n(train_features(t)), *MEANS)


@query
def sample_n_cut(t):
    """A sample smaller than the smallest table it is checked on."""
    return six(sampling.sample_n(train_features(t), 100), *MEANS)


@query
def standardize(t):
    return six(features.standardize(durable(train_features(t))), *FEATURES)


@query
def stratified_split(t):
    labelled = churn.churn_label(train_features(t), t.orders, CHURN_DAYS)
    return sampling.stratified_split(labelled, "churn").select("user_id", "churn", "is_test")


@query
def pca_covariance(t):
    table = reduce_ops.covariance_table(scaled_users(t))
    return six(table, "covariance")


# -- cluster validity and profiles on given labels ------------------------------------------------


def labelled(t: RetailTables, modulus: int = 4, scaled: bool = True) -> DataFrame:
    """Users with a label both engines can compute."""
    users = durable(train_features(t))
    rows = features.standardize(users) if scaled else users
    return rows.withColumn("cluster", (F.col("user_id") % modulus).cast("int"))


@query
def silhouette(t):
    return six(validity.silhouette(durable(labelled(t)), FEATURES), "silhouette")


@query
def silhouette_sq(t):
    return six(validity.silhouette_sq(labelled(t), FEATURES), "silhouette_sq")


@query
def calinski_harabasz(t):
    return six(validity.calinski_harabasz(labelled(t), FEATURES), "calinski_harabasz")


@query
def davies_bouldin(t):
    return six(validity.davies_bouldin(labelled(t), FEATURES), "davies_bouldin")


@query
def inertia(t):
    return six(validity.inertia(labelled(t), FEATURES), "inertia")


@query
def cluster_means(t):
    return six(
        profiles.cluster_means(labelled(t, scaled=False)),
        *FEATURES,
        *[f"overall_{c}" for c in FEATURES],
    )


@query
def profile_sizes(t):
    return six(profiles.profile_sizes(labelled(t, scaled=False)), *FEATURES)


@query
def classify_cluster(t):
    # many small clusters, so that every description has a chance to occur
    means = profiles.cluster_means(labelled(t, 200, scaled=False))
    return means.select("cluster", profiles.classify_cluster().alias("description"))


@query
def cluster_profiles(t):
    return profiles.cluster_profiles(labelled(t, scaled=False))


@query
def overall_mean(t):
    return profiles.overall_mean(train_features(t))


@query
def profile_delta(t):
    return profiles.profile_delta(labelled(t, scaled=False))


def _given_metrics(t: RetailTables) -> DataFrame:
    """Metric rows of two labelings for k = 2..4, stacked."""
    users = durable(scaled_users(t))
    labels = {
        "by_user": lambda k: F.col("user_id") % k,
        "by_reach": lambda k: F.when(F.col("unique_products") > 0, 0).otherwise(
            1 + F.col("user_id") % (k - 1)
        ),
    }
    ks = (2, 3, 4)
    return segmentation.stack_results(
        {
            name: validity.metric_table(
                users.withColumns({f"cluster_{k}": label(k).cast("int") for k in ks}),
                FEATURES,
                name,
                {k: f"cluster_{k}" for k in ks},
            )
            for name, label in labels.items()
        }
    )


METRICS = ("silhouette", "calinski_harabasz", "davies_bouldin")


@query
def stack_results(t):
    return six(_given_metrics(t), *METRICS)


@query
def sort_results(t):
    return six(segmentation.sort_results(_given_metrics(t)), *METRICS)


@query
def best_model(t):
    return six(validity.best_model(durable(_given_metrics(t))), *METRICS, "mean_rank")


@query
def best_fitted_model(t):
    """The fitted models of all methods on raw and reduced users, best first."""
    scaled = durable(scaled_users(t))
    raw = segmentation.representation(scaled, "raw")
    return segmentation.rank_models({"raw": raw, **segmentation.representations(scaled, ["PCA"])})


# -- scores on given predictions ---------------------------------------------------------------------


def predicted(t: RetailTables) -> DataFrame:
    """Churn labels with a score and a prediction both engines can compute."""
    users = churn.churn_label(train_features(t), t.orders, CHURN_DAYS)
    score = F.col("average_days_btw_orders") * F.col("total_max_orders") / F.lit(1000.0)
    return durable(
        users.select("user_id", F.col("churn").alias("label"), score.alias("score")).withColumn(
            "prediction", (F.col("score") > 0.25).cast("int")
        )
    )


@query
def churn_label(t):
    return six(churn.churn_label(train_features(t), t.orders), *MEANS)


@query
def class_balance(t):
    users = churn.churn_label(train_features(t), t.orders, CHURN_DAYS)
    return six(churn.class_balance(users), "ratio")


@query
def class_weight(t):
    users = durable(churn.churn_label(train_features(t), t.orders, CHURN_DAYS))
    return six(churn.class_weight(users).select("user_id", "churn", "weight"), "weight")


@query
def confusion_matrix(t):
    return scoring.confusion_matrix(predicted(t))


@query
def classification_report(t):
    return six(scoring.classification_report(predicted(t)), "precision", "recall", "f1")


@query
def roc_auc(t):
    return six(scoring.roc_auc(predicted(t)), "roc_auc")


@query
def average_precision(t):
    return six(scoring.average_precision(predicted(t)), "average_precision")


@query
def roc_curve(t):
    return six(scoring.roc_curve(predicted(t)), "fpr", "tpr", "threshold")


@query
def roc_curve_all_points(t):
    return six(
        scoring.roc_curve(predicted(t), drop_intermediate=False), "fpr", "tpr", "threshold"
    )


@query
def pr_curve(t):
    return six(scoring.pr_curve(predicted(t)), "precision", "recall", "threshold")


# -- one fuzzy step from given centres -------------------------------------------------------------------

GIVEN_CENTRES = ((-0.5,) * len(FEATURES), (0.5,) * len(FEATURES), (0.0,) * len(FEATURES))


@query
def fuzzy_step(t):
    stepped = fuzzy.fuzzy_step(scaled_users(t), FEATURES, np.array(GIVEN_CENTRES))
    return six(stepped, "weight", "objective", *FEATURES)


def given_fuzzy_model() -> fuzzy.FuzzyModel:
    return fuzzy.FuzzyModel(FEATURES, np.array(GIVEN_CENTRES), 2.0, (), float("nan"), False)


@query
def fuzzy_labels(t):
    rows = given_fuzzy_model().transform(scaled_users(t))
    return six(
        rows.select("user_id", "cluster", F.array_max("memberships").alias("membership")),
        "membership",
    )


@query
def partition_coefficient(t):
    rows = given_fuzzy_model().transform(scaled_users(t))
    return six(validity.partition_coefficient(rows), "partition_coefficient")


# -- fitted models (no SQL counterpart) ---------------------------------------------------------------------


@query
def attach_labels(t):
    users = durable(train_features(t))
    labels = given_fuzzy_model().transform(features.standardize(users))
    return six(users.join(labels.select("user_id", "cluster"), "user_id"), *MEANS)


@query
def pca(t):
    return six(reduce_ops.pca(scaled_users(t)), "pc1", "pc2", "pc3")


@query
def autoencoder(t):
    """Loss over all users before each round of training, and at its end."""
    losses = train_autoencoder(scaled_users(t), FEATURES).losses
    return t.spark.createDataFrame(list(enumerate(losses)), "round int, loss double")


@query
def autoencode(t):
    return encode(scaled_users(t), FEATURES)


@query
def autoencoder_step(t):
    """Loss and gradient sums of the first step, from fixed weights."""
    weights = np.sin(np.arange(1, 187)) / 2.0
    sums = autoencoder_ops.gradient_sums(scaled_users(t), FEATURES, weights)
    return six(sums, "value")


@query
def nearest_neighbours(t):
    near = neighbours.nearest_neighbours(scaled_users(t), FEATURES)
    place = Window.partitionBy("user_id").orderBy("distance")
    return six(
        near.select("user_id", F.row_number().over(place).alias("place"), "distance"), "distance"
    )


@query
def neighbour_embedding(t):
    return neighbours.neighbour_embedding(durable(scaled_users(t)), FEATURES)


_layouts: dict[tuple[str, str], segmentation.Representation] = {}


def _layout(t: RetailTables) -> segmentation.Representation:
    """The point layout; the queries on it read the same one within an application."""
    place = (t.spark.sparkContext.applicationId, t.directory)
    if place not in _layouts:
        _layouts[place] = segmentation.representations(scaled_users(t), ["Layout"])["Layout"]
    return _layouts[place]


@query
def neighbour_layout(t):
    return _layout(t).rows


@query
def layout_placed(t):
    """Users by all of their lines, placed in the layout of their last orders."""
    new = durable(features.standardize(durable(features.user_features(t.orders, t.lines))))
    return layout.place(new, durable(scaled_users(t)), _layout(t).rows, FEATURES)


def _given_centres(k: int) -> np.ndarray:
    return np.array([[np.sin(100 * k + 10 * c + i) for i in range(len(FEATURES))] for c in range(k)])


def _centre_rows(t, found) -> DataFrame:
    rows = [(k, c, float(cost), float(n[c]), *map(float, at[c])) for k, (cost, n, at) in found.items() for c in range(k)]
    shape = "k int, centre int, cost double, taken double, " + ", ".join(f"{c} double" for c in FEATURES)
    return six(t.spark.createDataFrame(rows, shape), "cost", *FEATURES)


@query
def lloyd_step(t):
    """Costs, sizes and centres after a step of models of two to four given centres, all
    in one pass."""
    blocks = packed_blocks(scaled_users(t), list(FEATURES), "user_id", 512)
    found = lloyd.lloyd_step(blocks, len(FEATURES), [_given_centres(k) for k in (2, 3, 4)])
    return _centre_rows(t, dict(zip((2, 3, 4), found)))


@query
def minibatch_step(t):
    """Three given centres that have taken 10, 200 and 3,000 rows take in a batch of all
    users."""
    blocks = packed_blocks(scaled_users(t), list(FEATURES), "user_id", 512)
    centres, taken = _given_centres(3), np.array([10.0, 200.0, 3000.0])
    ((cost, rows, mean),) = lloyd.lloyd_step(blocks, len(FEATURES), [centres])
    after, taken = lloyd.take_in(centres, taken, rows, mean * rows[:, None])
    return _centre_rows(t, {3: (cost, taken, after)})


@query
def em_step(t):
    """Mean log-likelihood, weights, means and second moments after a step of given
    mixtures of two and three components, in one pass."""
    blocks = packed_blocks(scaled_users(t), list(FEATURES), "user_id", 512)
    d, given = len(FEATURES), []
    for k in (2, 3):
        spread = [np.diag([1.5 + np.cos(100 * k + 10 * c + i) for i in range(d)]) for c in range(k)]
        given.append(mixture.Mixture(np.arange(1, k + 1) / (k * (k + 1) / 2), _given_centres(k), np.array(spread)))
    rows = []
    for likelihood, after in mixture.em_step(blocks, d, given, floor=0.0):
        k = len(after.weights)
        for c in range(k):
            covariance = after.covariances[c]
            rows.append((k, c, float(likelihood), float(after.weights[c]), *map(float, after.means[c]), *map(float, np.diag(covariance)), float(covariance[0, 1])))
    names = ["likelihood", "weight", *FEATURES, *[f"{c}_variance" for c in FEATURES], "covariance"]
    shape = "k int, component int, " + ", ".join(f"{c} double" for c in names)
    return six(t.spark.createDataFrame(rows, shape), *names)


@query
def kmeans_elbow(t):
    return partition.kmeans_elbow(scaled_users(t), FEATURES)


def _raw(t: RetailTables) -> segmentation.Representation:
    return segmentation.representation(scaled_users(t), "raw")


def _reduced(t: RetailTables, name: str) -> dict[str, segmentation.Representation]:
    if name == "Layout":
        return {name: _layout(t)}
    return segmentation.representations(scaled_users(t), [name])


# the sample is the analysis' own, for this one silhouette
@query
def kmeans_sweep(t):
    return segmentation.minibatch_sweep(_raw(t), sample_size=sampling.SAMPLE_SIZE)


@query
def fuzzy_cmeans(t):
    return segmentation.fuzzy_sweep(_raw(t))


@query
def ward(t):
    """Labels of one merge tree for k = 2..9."""
    return ward_ops.ward(durable(scaled_users(t)), FEATURES).select(
        "user_id", *[f"cluster_{k}" for k in partition.KS]
    )


@query
def ward_sweep(t):
    return segmentation.ward_sweep(_raw(t))


@query
def gmm(t):
    return segmentation.gmm_sweep(_raw(t))


def _per_representation(name, sweep):
    """One query per representation, each over k = 2..9; the plain name is PCA's."""

    def register(suffix, reduced):
        def run(t):
            return sweep(_reduced(t, reduced))

        run.__name__ = f"{name}{suffix}"
        query(run)

    for reduced in ("PCA", "Autoencoder", "Neighbours", "Layout"):
        register("" if reduced == "PCA" else f"_{reduced.lower()}", reduced)


_per_representation("kmeans_reps", segmentation.kmeans_reps)
_per_representation("fuzzy_cmeans_reps", segmentation.fuzzy_cmeans_reps)
_per_representation("ward_reps", segmentation.ward_reps)
_per_representation("gmm_reps", segmentation.gmm_reps)


@query
def final_model(t):
    return profiles.cluster_profiles(segmentation.final_model(train_features(t)).labelled)


_churn_runs: dict[tuple[str, str], churn_plan.ChurnRun] = {}


def _churn_run(t: RetailTables) -> churn_plan.ChurnRun:
    """The fitted run; the queries below read the same one within an application."""
    place = (t.spark.sparkContext.applicationId, t.directory)
    if place not in _churn_runs:
        _churn_runs[place] = churn_plan.run_churn(train_features(t), t.orders, CHURN_DAYS)
    return _churn_runs[place]


@query
def boost_bins(t):
    """Cut points of the features at quantiles weighted by class."""
    users = durable(churn.churn_label(train_features(t), t.orders, CHURN_DAYS))
    sketch = boosting.weighted_sketch(churn.class_weight(users), FEATURES, "weight")
    cuts = boosting.cut_points(sketch, len(FEATURES))
    rows = [(f, i, c) for f, found in enumerate(cuts) for i, c in enumerate(found)]
    return six(t.spark.createDataFrame(rows, "feature int, place int, cut double"), "cut")


@query
def boost_level(t):
    """The splits of the third level of a tree, given bins, scores and two levels."""
    users = churn.churn_label(features.standardize(durable(train_features(t))), t.orders, CHURN_DAYS)
    width = [F.least(F.greatest(F.floor(F.col(c) * 4) + 8, F.lit(0)), F.lit(15)).cast("int") for c in FEATURES]
    width[0] = F.when(F.col("user_id") % 11 == 0, -1).otherwise(width[0])
    rows = users.select(
        F.array(*width).alias("bins"), F.col("churn").alias("y"),
        (1.0 + F.col("user_id") % 3).alias("w"), F.sin(F.col("user_id").cast("double")).alias("margin"),
    )
    rows = durable(rows)
    unit = boosting.unit_of(rows.agg(F.sum("w")).first()[0] or 0.0)
    tree = boosting.Tree({1: (3, 8, True), 2: (4, 7, True), 3: (0, 8, False)})
    sums = boosting.histogram(boosting.packed(rows), tree, [4, 5, 6, 7], unit)
    splits = t.spark.createDataFrame(
        [astuple(s) for s in boosting.best_splits(sums.toArrow(), unit)],
        "node long, feature int, bin int, missing_left boolean, gain double, "
        "g_left double, h_left double, g_right double, h_right double",
    )
    values = {f"{side}_value": -F.col(f"g_{side}") / (F.col(f"h_{side}") + 1.0) for side in ("left", "right")}
    return six(splits.withColumns(values), "gain", "g_left", "h_left", "g_right", "h_right", *values)


@query
def churn_model(t):
    return _churn_run(t).report()


@query
def churn_predict(t):
    return _churn_run(t).scored.select("user_id", "churn", "prediction", "score")


@query
def churn_evaluation(t):
    """Confusion counts and areas of the fitted model on its test users."""
    run = _churn_run(t)
    counts = run.confusion().select(
        F.concat(F.lit("actual "), "actual", F.lit(" predicted "), "predicted").alias("measure"),
        F.col("n").cast("double").alias("value"),
    )
    areas = run.areas().select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), F.col(c).alias("value"))
                    for c in ("roc_auc", "average_precision")
                ]
            )
        )
    )
    return counts.unionByName(areas)


@query
def churn_curves(t):
    """Both curves of the fitted model on its test users."""
    run = _churn_run(t)
    roc = run.roc().select(F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"), "threshold")
    pr = run.precision_recall().select(
        F.lit("precision_recall").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y"), "threshold"
    )
    return roc.unionByName(pr)
