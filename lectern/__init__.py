"""lectern: a Spark-first engine for building, searching and curating a catalog."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
