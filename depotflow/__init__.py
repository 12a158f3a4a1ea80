"""Warehouse and logistics analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions and state classes that run inside tasks travel with the job, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
