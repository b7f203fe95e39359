"""Shopper segmentation and churn analysis over basket data, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas travel by value, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
