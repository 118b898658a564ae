"""tessera: consolidation of partial per-view segments into whole objects, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what they run travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
