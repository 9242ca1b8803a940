"""barloom: bar-clock time series analytics and data preparation on PySpark.

The package is shipped to executors by value, so that a cluster whose workers do
not have it installed can run every operator.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
