"""Year-aware literature analytics on Spark: every operator is a DataFrame -> DataFrame function."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
