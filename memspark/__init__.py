"""memspark: batch jobs that turn document collections into a searchable memory.

Everything is a function from DataFrames to DataFrames; nothing here starts a session.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
