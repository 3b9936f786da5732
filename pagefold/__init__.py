"""pagefold: a Spark-native document analytics engine."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code, so executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
