"""netloom: planning tree-shaped utility networks on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
