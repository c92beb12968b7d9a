"""Operators for training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
