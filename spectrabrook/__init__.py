"""Spectral time-series and text-corpus engine on Spark DataFrames.

Functions that run on executors are pickled by value, so a cluster needs only
the public libraries (NumPy, pandas, PyArrow) and not this package itself.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
