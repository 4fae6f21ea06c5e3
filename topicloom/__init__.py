"""Topic analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
