"""Sparline: line-attribution analytics and training-data operators on Spark DataFrames.

Functions that run in Python workers are shipped by value, so that executors need not
have the package installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
