"""Review analytics and mediation statistics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas travel to the executors by value, so workers
# need numpy and pandas but not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
