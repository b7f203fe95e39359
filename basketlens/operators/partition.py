"""Settings of the partitions, the elbow curve, and fits side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.operators.lloyd import kmeans
from basketlens.operators.sampling import SEED

# Seeds, restarts and cluster counts of the analysis.
ELBOW_SEED = 45
RESTARTS = 10
KS = tuple(range(2, 10))

# Fits that may run at the same time.
PARALLEL_FITS = 4

# The limits of an iteration.
KMEANS_ITERATIONS = 300
KMEANS_TOLERANCE = 1e-3

VECTOR = "_features"


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the vector column the estimators read; persist the result before a sweep."""
    return VectorAssembler(inputCols=list(columns), outputCol=VECTOR).transform(df)


def fit_together(
    spark: SparkSession, fits: Sequence[Callable[[], object]], parallelism: int = PARALLEL_FITS
) -> list:
    """Run independent fits side by side, as the library's cross validator does:
    the jobs of one fit fill the cores that another leaves idle."""
    with ThreadPool(max(1, min(parallelism, len(fits)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(f) for f in fits])


def kmeans_elbow(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int] = KS, seed: int = ELBOW_SEED, key: str = "user_id"
) -> DataFrame:
    """Within-cluster squared error per cluster count."""
    models = kmeans(df, columns, ks, 1, seed, KMEANS_ITERATIONS, KMEANS_TOLERANCE, key)
    return df.sparkSession.createDataFrame([(k, m.cost) for k, m in models.items()], "k int, inertia double")
