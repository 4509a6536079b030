"""Evaluation of conversational memory as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to the executors travel by value: they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
