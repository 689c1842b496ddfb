"""Knowledge-base analytics expressed with PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
