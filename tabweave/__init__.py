"""A PySpark-native engine for self-described tabular data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster needs no
# installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
