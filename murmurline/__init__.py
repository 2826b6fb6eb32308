"""murmurline: short-text event streams, hourly series and their analysis on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels of this package travel with their tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
