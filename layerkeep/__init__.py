"""Layered keyed rows on Spark: snapshots, compacted deltas and ordered upserts read as one view.

Functions that run in Python workers are pickled by value, so a cluster needs
no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
