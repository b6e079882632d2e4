"""Operators for preparing training text; nothing else in the library imports this package.

Functions that run in Spark's Python workers travel by value, so that the workers need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
