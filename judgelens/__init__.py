"""judgelens: Spark-native analysis of automated judges that score text responses."""

import sys as _sys

__version__ = "0.1.0"

# Python tasks (mapInPandas / applyInPandas functions) are pickled by value, so executors run
# them without having this package installed.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without by-value registration
    pass
