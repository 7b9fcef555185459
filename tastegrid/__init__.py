"""Offline recommendation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers travel with the
# task, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
