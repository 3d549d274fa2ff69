"""cadastra: a Spark-native property analytics engine."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
