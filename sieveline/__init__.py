"""sieveline: certified text classification and data sourcing on Spark.

Rows stay in DataFrames; only per-head or per-stratum aggregates reach the driver.
Functions that run on executors travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
