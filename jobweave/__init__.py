"""jobweave - job-market analytics as composable Spark DataFrame operators.

Python functions of this package are shipped to executors by value, so a
cluster's workers need PySpark, pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
