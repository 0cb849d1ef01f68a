"""tidemark: a PySpark-native analytics engine for timestamped discussion records and daily market bars."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
