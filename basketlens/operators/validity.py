"""Cluster validity indices.

All but the Euclidean silhouette come from one pass of per-cluster sums; what remains
is a table with one row per cluster.  Coordinates are plain numeric columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.operators.blocks import matrix, packed_blocks, squared_distances
from basketlens.operators.sampling import SEED, sample_n
from basketlens.session import durable

# Rows of a block of the Euclidean silhouette, from so many to so many: a block meets every
# other one, so rows are copied, and partial sums handed on, as often as there are blocks.
SILHOUETTE_ROWS, LARGEST_SILHOUETTE_ROWS = 8192, 262144
# numbers that a block's partial sums may have
_TOTALS = 1 << 22
# squared distances below this part of the largest squared norm are taken axis by axis
_CLOSE = 1e-6


def cluster_sums(
    df: DataFrame, columns: Sequence[str], label: str = "cluster", by: Sequence[str] = ()
) -> DataFrame:
    """Per cluster: size, coordinate sums and sum of squared norms.

    ``by`` columns tell several labelings of the same rows apart.
    """
    squares = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    return df.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in columns],
        F.sum(squares).alias("sum_squares"),
    )


def _scatter(sums: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Clusters, rows, within- and between-cluster scatter, from the sums."""
    centre_square = sum(
        (F.col(f"sum_{c}") * F.col(f"sum_{c}") for c in columns), F.lit(0.0)
    ) / F.col("n")
    totals = sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("n").alias("n"),
        F.sum(F.col("sum_squares") - centre_square).alias("within"),
        F.sum(centre_square).alias("centres"),
        *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in columns],
    )
    return totals.select(
        *by, "clusters", "n", "within", (F.col("centres") - centre_square).alias("between")
    )


def calinski_harabasz(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "cluster",
    by: Sequence[str] = (),
    sums: DataFrame | None = None,
) -> DataFrame:
    """Between- over within-cluster scatter, each per degree of freedom."""
    sums = cluster_sums(df, columns, label, by) if sums is None else sums
    index = (F.col("between") / (F.col("clusters") - 1)) / (
        F.col("within") / (F.col("n") - F.col("clusters"))
    )
    usable = F.when(F.col("within") != 0.0, index).otherwise(F.lit(1.0))
    return _scatter(sums, columns, by).select(
        *by, usable.alias("calinski_harabasz")
    )


def inertia(
    df: DataFrame, columns: Sequence[str], label: str = "cluster", by: Sequence[str] = ()
) -> DataFrame:
    """Sum of squared distances to the own centroid."""
    return _scatter(cluster_sums(df, columns, label, by), columns, by).select(
        *by, F.col("within").alias("inertia")
    )


def davies_bouldin(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "cluster",
    by: Sequence[str] = (),
    sums: DataFrame | None = None,
) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centroid distance.

    The per-cluster sums are written first: their known size lets Spark broadcast
    the centroids instead of shuffling the rows to them.
    """
    keys = [*by, label]
    sums = durable(cluster_sums(df, columns, label, by)) if sums is None else sums
    centroids = sums.select(
        *keys, *[(F.col(f"sum_{c}") / F.col("n")).alias(f"centre_{c}") for c in columns]
    )
    offset = F.sqrt(
        sum(((F.col(c) - F.col(f"centre_{c}")) ** 2 for c in columns), F.lit(0.0))
    )
    spreads = (
        df.join(centroids, keys)
        .groupBy(*keys)
        .agg(
            F.avg(offset).alias("spread"),
            F.array(*[F.first(f"centre_{c}") for c in columns]).alias("centre"),
        )
    )
    # the clusters meet inside one array of k entries, not in a join
    clusters = spreads.groupBy(*by).agg(
        F.collect_list(F.struct(F.col(label).alias("id"), "spread", "centre")).alias("all")
    )

    def distance(a: Column, b: Column) -> Column:
        gaps = F.zip_with(a["centre"], b["centre"], lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v))

    def likeness(a: Column, b: Column) -> Column:
        apart = distance(a, b)
        return F.when(apart == 0.0, F.lit(0.0)).otherwise((a["spread"] + b["spread"]) / apart)

    worst = F.transform(
        "all",
        lambda a: F.array_max(
            F.transform(F.filter("all", lambda b: b["id"] != a["id"]), lambda b: likeness(a, b))
        ),
    )
    mean = F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / F.size("all")
    return clusters.select(*by, mean.alias("davies_bouldin"))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All distances of centred points as a product of matrices; small ones, which would
    cancel, axis by axis."""
    a, b = (left * left).sum(axis=1), (right * right).sum(axis=1)
    squared = np.column_stack([left, a, np.ones(len(left))]) @ np.column_stack([-2.0 * right, np.ones(len(right)), b]).T
    close = squared < _CLOSE * max(a.max(initial=0.0), b.max(initial=0.0))
    found = np.count_nonzero(close)
    if 10 * found > squared.size:
        squared = squared_distances(left, right)
    elif found:
        i, j = np.nonzero(close)
        squared[i, j] = ((left[i] - right[j]) ** 2).sum(axis=1)
    return np.sqrt(squared, out=squared)


def _totals(spots: np.ndarray, others: np.ndarray, member: np.ndarray, back: np.ndarray | None = None):
    """Per spot the sums of its distances to the others, by column of ``member``; with
    ``back``, the spots' own membership, also the others' sums of the same distances."""
    middle = others.mean(axis=0)
    spots, others = spots - middle, others - middle
    out = np.zeros((len(spots), member.shape[1]))
    returned = None if back is None else np.zeros((len(others), back.shape[1]))
    for at in range(0, len(spots), 256):
        for to in range(0, len(others), 2048):
            apart = _distances(spots[at : at + 256], others[to : to + 2048])
            out[at : at + 256] += apart @ member[to : to + 2048]
            if back is not None:
                returned[to : to + 2048] += apart.T @ back[at : at + 256]
    return out if back is None else (out, returned)


def silhouette_values(
    df: DataFrame,
    columns: Sequence[str],
    labels: Sequence[str] = ("cluster",),
    key: str = "user_id",
    block_rows: int | None = None,
) -> DataFrame:
    """Euclidean silhouette of every row among all rows.

    Rows are (key, labeling, silhouette); ``labels`` may name several label columns,
    which share the distances.  The work is the square of the table's rows, done once for
    each pair of packed blocks; :func:`silhouette_sq` is linear, and a sample may be scored
    by handing one in.
    """
    labels, columns = list(labels), list(columns)
    # a row per cluster
    sizes = (
        df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("labeling"), F.col(c).cast("long").alias("other")) for c in labels]))
        )
        .groupBy("labeling", "other")
        .agg(F.count(F.lit(1)).alias("members"))
        .toPandas()
    )
    clusters = {}
    for label in labels:
        found = sizes[sizes["labeling"] == label]
        if not found.empty and not 2 <= len(found) < found["members"].sum():
            raise ValueError(
                f"a silhouette needs at least 2 clusters and fewer than rows; {label} has "
                f"{len(found)} in {found['members'].sum()} rows"
            )
        # a row without a label has no silhouette and is in no other row's
        found = found.dropna().sort_values("other")
        clusters[label] = found["other"].to_numpy(dtype=float), found["members"].to_numpy(dtype=float)
    widest = sum(len(found) for found, _ in clusters.values())
    rows = int(sizes["members"].sum()) // len(labels)
    if block_rows is None:
        # totals of a block stay bounded, and there are some hundred pairs for the cores
        most = min(LARGEST_SILHOUETTE_ROWS, _TOTALS // max(1, widest))
        block_rows = max(1, min(max(rows // 16, SILHOUETTE_ROWS), most))
    named = [f"label{i}" for i in range(len(labels))]
    data = df.select(key, *[F.col(c).cast("long").alias(n) for c, n in zip(labels, named)], *columns)
    packed = packed_blocks(data, [*named, *columns], key, block_rows)
    last = packed.agg(F.max("block")).first()[0] or 0
    width = len(named) + len(columns)

    def members(held: np.ndarray) -> np.ndarray:
        """Per row a 1 in the column of its cluster, for all labelings side by side."""
        return np.hstack([(held[:, i : i + 1] == found).astype(float) for i, (found, _) in enumerate(clusters.values())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q, p = left.column("q")[0].as_py(), left.column("p")[0].as_py()
        mine, other = (matrix(t.column("x")[0].as_py(), width) for t in (left, right))
        spots, others = mine[:, len(named) :], other[:, len(named) :]
        if q == p:
            found = [(q, p, _totals(spots, others, members(other)).tobytes())]
        else:
            there, back = _totals(spots, others, members(other), members(mine))
            found = [(q, p, there.tobytes()), (p, q, back.tobytes())]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(zip(*found), kinds)], ["block", "beside", "totals"])

    # a pair of blocks meets once
    near = packed.select(F.col("block").alias("q"), F.explode(F.sequence("block", F.lit(last))).alias("p"), "x")
    far = packed.select(F.explode(F.sequence(F.lit(0), "block")).alias("q"), F.col("block").alias("p"), "x")
    sums = durable(
        near.groupBy("q", "p").cogroup(far.groupBy("q", "p")).applyInArrow(compare, "block int, beside int, totals binary")
    )

    def value(held: pa.Table, totals: pa.Table) -> pa.Table:
        x = matrix(held.column("x")[0].as_py(), width)
        total = sum(matrix(v.as_py(), widest) for v in totals.sort_by("beside").column("totals"))
        keys = held.column("keys").combine_chunks().flatten()
        at, parts = 0, []
        for i, (label, (found, n)) in enumerate(clusters.items()):
            own, each = x[:, i : i + 1] == found, total[:, at : at + len(found)]
            at += len(found)
            a = np.where(own, each / np.maximum(n - 1, 1), 0.0).sum(axis=1)
            b = np.where(own, np.inf, each / n).min(axis=1, initial=np.inf)
            scale = np.maximum(a, b)
            alone = (own * n).sum(axis=1) == 1
            with np.errstate(invalid="ignore"):
                score = np.where(alone | (scale == 0.0), 0.0, (b - a) / scale)
            scored = pa.array(score, mask=~own.any(axis=1) | (len(found) < 2))
            parts.append(pa.table([keys, pa.array([label] * len(keys), pa.string()), scored], [key, "labeling", "silhouette"]))
        return pa.concat_tables(parts)

    kind = df.schema[key].dataType.simpleString()
    return packed.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        value, f"`{key}` {kind}, labeling string, silhouette double"
    )


def silhouette(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "cluster",
    sample_size: int | None = None,
    seed: int = SEED,
    key: str = "user_id",
) -> DataFrame:
    """Mean Euclidean silhouette of all rows, or of a seeded sample among itself."""
    rows = df if sample_size is None else sample_n(df, sample_size, seed, key)
    values = silhouette_values(rows, columns, [label], key)
    return values.agg(F.avg("silhouette").alias("silhouette"))


def silhouette_sq(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "cluster",
    sums: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Squared-distance silhouette over every row, in one pass after the sums.

    The mean squared distance from a row to a cluster follows from the cluster's
    size, centroid and squared norms, so the cost is rows x clusters.
    """
    sums = cluster_sums(df, columns, label, by) if sums is None else sums
    packed = sums.groupBy(*by).agg(
        F.collect_list(
            F.struct(
                F.col(label).alias("id"),
                F.col("n").cast("double").alias("n"),
                F.array(*[F.col(f"sum_{c}") for c in columns]).alias("sums"),
                "sum_squares",
            )
        ).alias("_all")
    )
    norm = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    own_norm, own_point = F.col("_norm"), F.col("_point")

    def total(c: Column) -> Column:
        dots = F.zip_with(own_point, c["sums"], lambda x, s: x * s)
        dot = F.aggregate(dots, F.lit(0.0), lambda acc, v: acc + v)
        return F.greatest(c["n"] * own_norm + c["sum_squares"] - 2.0 * dot, F.lit(0.0))

    own = F.filter("_all", lambda c: c["id"] == F.col(label))
    other = F.filter("_all", lambda c: c["id"] != F.col(label))
    inside = F.element_at(
        F.transform(own, lambda c: F.when(c["n"] > 1, total(c) / (c["n"] - 1))), 1
    )
    nearest = F.array_min(F.transform(other, lambda c: total(c) / c["n"]))
    beside = df.join(packed, list(by)) if by else df.withColumn("_all", packed.scalar())
    scored = (
        beside.withColumn("_norm", norm)
        .withColumn("_point", F.array(*columns))
        .select(*by, inside.alias("a"), nearest.alias("b"))
    )
    scale = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (scale == 0.0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / scale
    )
    return scored.groupBy(*by).agg(F.avg(value).alias("silhouette_sq"))


def partition_coefficient(df: DataFrame, memberships: str = "memberships") -> DataFrame:
    """Mean squared membership; 1 is a crisp partition, 1/c a uniform one."""
    squared = F.aggregate(memberships, F.lit(0.0), lambda acc, u: acc + u * u)
    return df.agg(F.avg(squared).alias("partition_coefficient"))


def metric_table(
    df: DataFrame,
    columns: Sequence[str],
    method: str,
    labels: Mapping[int, str],
    sample_size: int | None = None,
    key: str = "user_id",
) -> DataFrame:
    """Rows (method, k, silhouette, calinski_harabasz, davies_bouldin).

    ``labels`` maps k to the label column of that clustering.  With a ``sample_size``
    the silhouette is the Euclidean one of a seeded sample of that size; without, the
    squared-distance one of all rows.  All k share one pass of sums and one of
    distances over the rows as they are.
    """
    by = ["_k"]
    clusters = {k: F.col(name).cast("int") for k, name in labels.items()}
    # a row per row and k, which the partial sums of a pass take in at once
    rows = df.select(
        *columns,
        F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), c.alias("cluster")) for k, c in clusters.items()])),
    )
    sums = durable(cluster_sums(rows, columns, by=by))
    if sums.where("cluster IS NOT NULL").select(*by).distinct().count() < len(clusters):
        raise ValueError("indices need a labelled row in every clustering")
    if sample_size is None:
        score = silhouette_sq(rows, columns, sums=sums, by=by).withColumnRenamed("silhouette_sq", "silhouette")
    else:
        sample = sample_n(df.select(key, *columns, *[c.alias(f"_{k}") for k, c in clusters.items()]), sample_size, key=key)
        values = silhouette_values(sample, columns, [f"_{k}" for k in clusters], key)
        score = values.groupBy(F.substring("labeling", 2, 10).cast("int").alias("_k")).agg(F.avg("silhouette").alias("silhouette"))
    # a row per k
    scores = durable(
        score.join(calinski_harabasz(rows, columns, sums=sums, by=by), by).join(
            davies_bouldin(rows, columns, sums=sums, by=by), by
        )
    )
    return scores.select(
        F.lit(method).alias("method"), F.col("_k").alias("k"), "silhouette", "calinski_harabasz", "davies_bouldin"
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """Metric rows with their rank per index and the mean of the three ranks.

    The first row is the chosen model.  The table has one row per fitted model.
    """
    def position(order: Column) -> Column:
        return F.rank().over(Window.orderBy(order))

    ranked = metrics.select(
        "*",
        position(F.desc("silhouette")).alias("silhouette_rank"),
        position(F.desc("calinski_harabasz")).alias("calinski_harabasz_rank"),
        position(F.asc("davies_bouldin")).alias("davies_bouldin_rank"),
    )
    mean = (
        F.col("silhouette_rank") + F.col("calinski_harabasz_rank") + F.col("davies_bouldin_rank")
    ) / 3.0
    return ranked.withColumn("mean_rank", mean).orderBy("mean_rank", "method", "k")
