"""Segmentation workflows: representations, sweeps over k, the final model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from basketlens.functions.scalars import argmax_label, round_half_even
from basketlens.operators import validity
from basketlens.operators.autoencoder import autoencode
from basketlens.operators.features import standardize
from basketlens.operators.fuzzy import MAX_ITERATIONS, fuzzy_cmeans
from basketlens.operators.layout import neighbour_layout
from basketlens.operators.lloyd import kmeans, minibatch_kmeans
from basketlens.operators.mixture import gaussian_mixtures, with_labels
from basketlens.operators.neighbours import neighbour_embedding
from basketlens.operators.partition import KS, RESTARTS, fit_together
from basketlens.operators.quality import drop_null_rows
from basketlens.operators.reduce import pca
from basketlens.operators.sampling import SEED
from basketlens.operators.ward import ward
from basketlens.session import durable
from basketlens.sources.schemas import FEATURES

# Fixed value: rows of a mini-batch.
BATCH_ROWS = 3000

# Iterations of fuzzy c-means on a reduced representation.
REDUCED_ITERATIONS = 300


@dataclass(frozen=True)
class Representation:
    name: str
    rows: DataFrame
    columns: tuple[str, ...]


def representation(scaled: DataFrame, name: str, key: str = "user_id") -> Representation:
    """``scaled`` under one of the names raw, Autoencoder, PCA, Neighbours, Layout."""
    builders = {
        "raw": lambda: scaled.select(key, *FEATURES),
        "Autoencoder": lambda: autoencode(scaled, FEATURES, key),
        "PCA": lambda: pca(scaled, FEATURES, 3, key),
        "Neighbours": lambda: neighbour_embedding(scaled, FEATURES, key=key),
        "Layout": lambda: neighbour_layout(scaled, FEATURES, key=key),
    }
    rows = builders[name]()
    return Representation(name, rows, tuple(c for c in rows.columns if c != key))


def representations(
    scaled: DataFrame, names: Sequence[str] = ("Autoencoder", "PCA", "Neighbours")
) -> dict[str, Representation]:
    """The reduced representations, each written once."""
    scaled = durable(scaled)
    built = (representation(scaled, n) for n in names)
    return {r.name: Representation(r.name, durable(r.rows), r.columns) for r in built}


def stack_results(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One metric table out of several, tagged with the method, method first."""
    tagged = [
        df.withColumn("method", F.lit(name)).select(
            "method", *[c for c in df.columns if c != "method"]
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def sort_results(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("method", "k")


def round_results(metrics: DataFrame, places: int = 4, index_places: int = 2) -> DataFrame:
    return metrics.withColumns(
        {
            "silhouette": round_half_even(F.col("silhouette"), places),
            "calinski_harabasz": round_half_even(F.col("calinski_harabasz"), index_places),
            "davies_bouldin": round_half_even(F.col("davies_bouldin"), places),
        }
    )


def _scores(
    labelled: DataFrame, rep: Representation, ks: Sequence[int], sample_size: int | None = None
) -> DataFrame:
    """Metric rows of a table that holds a label column ``cluster_<k>`` per k."""
    labels = {k: f"cluster_{k}" for k in ks}
    return validity.metric_table(durable(labelled), rep.columns, rep.name, labels, sample_size)


def kmeans_sweep(rep: Representation, ks: Sequence[int] = KS, restarts: int = 1) -> DataFrame:
    """Full passes that all sizes and restarts share."""
    models = kmeans(rep.rows, rep.columns, ks, restarts)
    return _scores(rep.rows.withColumns({f"cluster_{k}": m.label() for k, m in models.items()}), rep, ks)


def minibatch_sweep(
    rep: Representation, ks: Sequence[int] = KS, batch_rows: int = BATCH_ROWS, sample_size: int | None = None
) -> DataFrame:
    """With a ``sample_size`` the silhouette is the Euclidean one of such a sample."""
    models = minibatch_kmeans(rep.rows, rep.columns, ks, batch_rows)
    labelled = rep.rows.withColumns({f"cluster_{k}": m.label() for k, m in models.items()})
    return _scores(labelled, rep, ks, sample_size)


def gmm_sweep(rep: Representation, ks: Sequence[int] = KS) -> DataFrame:
    models = gaussian_mixtures(rep.rows, rep.columns, ks)
    return round_results(_scores(with_labels(rep.rows, models), rep, ks))


def fuzzy_sweep(
    rep: Representation, ks: Sequence[int] = KS, maxiter: int = MAX_ITERATIONS
) -> DataFrame:
    """Adds the partition coefficient to the three indices."""
    models = fuzzy_cmeans(rep.rows, rep.columns, ks, maxiter=maxiter)
    labelled = rep.rows.withColumns(
        {f"cluster_{k}": argmax_label(models[k].memberships()) for k in ks}
    )
    coefficient = reduce(
        lambda acc, k: acc.when(F.col("k") == k, F.lit(models[k].fpc)), ks, F
    )
    return _scores(labelled, rep, ks).withColumn("partition_coefficient", coefficient)


def ward_sweep(rep: Representation, ks: Sequence[int] = KS) -> DataFrame:
    return round_results(_scores(ward(rep.rows, rep.columns, ks), rep, ks))


def sweep_representations(reps: Mapping[str, Representation], sweep, **options) -> DataFrame:
    """One sweep per representation, stacked and sorted."""
    return sort_results(stack_results({n: sweep(r, **options) for n, r in reps.items()}))


def kmeans_reps(reps: Mapping[str, Representation], ks: Sequence[int] = KS) -> DataFrame:
    return sweep_representations(reps, kmeans_sweep, ks=ks, restarts=RESTARTS)


def fuzzy_cmeans_reps(reps: Mapping[str, Representation], ks: Sequence[int] = KS) -> DataFrame:
    return round_results(
        sweep_representations(reps, fuzzy_sweep, ks=ks, maxiter=REDUCED_ITERATIONS)
    )


def ward_reps(reps: Mapping[str, Representation], ks: Sequence[int] = KS) -> DataFrame:
    return sweep_representations(reps, ward_sweep, ks=ks)


def gmm_reps(reps: Mapping[str, Representation], ks: Sequence[int] = KS) -> DataFrame:
    return sweep_representations(reps, gmm_sweep, ks=ks)


def rank_models(reps: Mapping[str, Representation], ks: Sequence[int] = KS) -> DataFrame:
    """Every method fitted on every representation, ranked by the mean of its ranks per
    index; ``method`` names both.  Sweeps depend on nothing but their representation, and
    run side by side: a pass is a small job that leaves most cores idle."""
    sweeps = {"fuzzy_cmeans": fuzzy_sweep, "ward": ward_sweep, "gmm": gmm_sweep, "kmeans": kmeans_sweep}  # the longest first

    def scored(name: str, sweep, rep: Representation) -> DataFrame:
        return durable(
            round_results(sweep(rep, ks)).select(
                F.lit(f"{name} {rep.name}").alias("method"), "k", "silhouette", "calinski_harabasz", "davies_bouldin"
            )
        )

    fits = [partial(scored, name, sweep, rep) for name, sweep in sweeps.items() for rep in reps.values()]
    metrics = fit_together(next(iter(reps.values())).rows.sparkSession, fits)
    return validity.best_model(durable(reduce(DataFrame.unionByName, metrics)))


@dataclass(frozen=True)
class FinalModel:
    labelled: DataFrame  # unscaled features, memberships and cluster per user
    centres: object
    fpc: float


def final_model(
    features: DataFrame,
    c: int = 2,
    reduced: str = "Neighbours",
    seed: int = SEED,
) -> FinalModel:
    """Fuzzy c-means on a reduced view of all users without missing features."""
    complete = durable(drop_null_rows(features, FEATURES))
    rep = representation(standardize(complete), reduced)
    rows = durable(rep.rows)
    model = fuzzy_cmeans(rows, rep.columns, [c], seed=seed)[c]
    labels = model.transform(rows).select("user_id", "memberships", "cluster")
    return FinalModel(complete.join(labels, "user_id"), model.centres, model.fpc)
