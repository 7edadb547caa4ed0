"""Slot occupancy analytics on Spark: ordered replay, folds of change logs, and utilization reports."""

import sys

from pyspark import cloudpickle

# The functions run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
