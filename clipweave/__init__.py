"""clipweave: annotated-timeline and speech-dataset analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so a cluster needs no copy of
# this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
