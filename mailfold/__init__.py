"""mailfold: mail analytics on Spark (see README.md)."""

import sys as _sys

# Functions that run on executors (pandas UDFs, mapInPandas bodies) are
# pickled by value, so workers need no copy of this package on their path:
# the code travels with the task, on a cluster as in a local session started
# from any working directory.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  older pickler: workers import the package instead
    pass
