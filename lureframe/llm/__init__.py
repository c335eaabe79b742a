"""Operators of a training-data pipeline.

Nothing outside this folder imports it.  Its functions travel to the executors
by value, so the workers need no copy of the package on their path.
"""
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
