"""Code-list linkage and data-preparation operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
