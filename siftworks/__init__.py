"""Siftworks: code-evidence analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors by value, so that these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
