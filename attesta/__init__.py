"""Attesta: claim verification, source independence and retrieval on Spark DataFrames."""

import sys as _sys

try:  # ship this package's functions with the tasks, so executors need no copy of it
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # older PySpark: pass the package with --py-files
    pass
