"""Citation-integrity and claim-evidence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value, so that a cluster needs no copy of it on its own disks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
