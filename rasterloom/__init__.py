"""Spark-native bi-level raster pipeline, with operators for training data beside it.

Functions that run on executors are pickled by value, so executors need no copy of
this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
