"""A PySpark-native engine for code-evidence indexing, retrieval and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
