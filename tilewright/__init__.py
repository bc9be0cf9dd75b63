"""A Spark-native engine for tiles, features and their pipelines.

Functions that run in Python workers travel by value, so that executors need no installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
