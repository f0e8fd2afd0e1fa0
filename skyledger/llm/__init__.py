"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value. Objects in broadcast variables
# do not: they need the package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
