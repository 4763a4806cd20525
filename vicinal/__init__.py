"""Similarity search over large vector tables and keyed tables, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so executors need
# Spark, NumPy and Arrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
