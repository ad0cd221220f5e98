"""Text-corpus and message analytics written for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside each task, so the
# workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
