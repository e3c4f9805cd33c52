"""A Spark-native engine for security and quality signals, kept as tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their tasks, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
