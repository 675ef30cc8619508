"""Spark jobs for spatial series, surface grids and profile descriptors."""

import sys

from pyspark import cloudpickle

# Grouped functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
