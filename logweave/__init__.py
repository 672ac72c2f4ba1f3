"""Log routing and integrity jobs as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so the
# package need not be installed (or on the path) of the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
