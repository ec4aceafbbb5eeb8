"""sievework: a PySpark-native engine for curating labelled text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
