"""Conversation analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so no archive has to be shipped.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
