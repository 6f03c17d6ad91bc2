"""driftwell: Spark-first mining of change histories of semi-structured files."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
