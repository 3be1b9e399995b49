"""Spark-native engine for content trees: sources, segmentation, structuring, search, merging, snapshots, export."""

import sys

from pyspark import cloudpickle

# Functions for executors travel by value, so a cluster needs no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
