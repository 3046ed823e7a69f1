"""tunesift: catalogue analytics and content-based recommendation on Spark.

Every operator takes and returns DataFrames; the work is expressed with
DataFrame / SQL / ML built-ins so Catalyst can prune, push down and plan it.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (the mapInPandas kernels) are
# pickled by value, so executors need no installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
