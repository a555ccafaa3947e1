"""Spark-native analytics for dated, located free-text reports."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
