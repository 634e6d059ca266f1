"""Chart data, question grading and collection reporting as plain Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
