import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketlens.session import local_session  # noqa: E402
from basketlens.sources.retail import RetailTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def retail(spark):
    return RetailTables(spark, SMALL)


@pytest.fixture(scope="session")
def blobs(spark):
    """Three well separated groups of 40 points; the true group is kept."""
    import numpy as np

    rng = np.random.default_rng(3)
    spots = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    rows = [
        (int(40 * g + i), int(g), *map(float, spots[g] + rng.normal(0, 0.5, 2)))
        for g in range(3)
        for i in range(40)
    ]
    return spark.createDataFrame(rows, "user_id long, truth int, x double, y double")
