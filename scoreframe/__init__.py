"""Scoring of model-generated answers and SQL as ordinary Spark DataFrame jobs."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the tasks with the job, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
