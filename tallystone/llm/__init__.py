"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it. Functions that run on executors are
shipped by value, so workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
