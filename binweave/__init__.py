"""Spark-native analytics over sparse two-dimensional interaction matrices."""

import sys

from pyspark import cloudpickle

# Task functions travel to the workers by value, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
