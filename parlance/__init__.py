"""Community language analytics and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so an executor
# needs no copy of this package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
