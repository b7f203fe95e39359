"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores.  Every query is run to completion into a no-op sink.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.session import local_session
from registry import QUERIES

HEADLINE = (
    "missing_report",
    "duplicate_check",
    "describe",
    "orders_per_user_hist",
    "reorder_by_cart_pos",
    "top_products",
    "top_aisles",
    "organic_share",
    "wide_table",
    "user_features",
    "standardize",
    "sample_n",
    "stratified_split",
    "pca",
    "silhouette",
    "calinski_harabasz",
    "davies_bouldin",
    "cluster_profiles",
    "fuzzy_step",
    "kmeans_sweep",
    "ward",
    "autoencoder",
    "roc_curve",
    "average_precision",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    # class loading and code generation are paid once, outside the timings
    QUERIES["user_features"](spark, directory).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
