"""Grid, frame, chunk and material-plan operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Grouped-map and state functions travel to the executors with their code, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
