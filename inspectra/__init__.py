"""Inspectra: an analytics engine for dated inspection records, built on Spark DataFrames.

The package is registered for pickling by value, so Python functions that run on executors need no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
