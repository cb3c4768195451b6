"""Spark-native operators for panel, contest and event-sequence data."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the task, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
