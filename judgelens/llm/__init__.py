"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. Task functions are shipped by value, so
executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
